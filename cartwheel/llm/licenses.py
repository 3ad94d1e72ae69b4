"""License scan: a trained paragraph classifier with template confirmation.

A multinomial logistic regression over hashed word n-grams (Spark ML) names the
license family of a paragraph; a class ``unknown`` is trained on paragraphs of the
corpus and calibrated so that a family must be as likely as on its own notices. A
prediction counts only if the paragraph also holds the words of one of the
family's templates.

Everything on the main path is DataFrame, SQL and Spark ML feature code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UNKNOWN = "unknown"
DIMENSIONS = 1 << 13
#: Share of a template's word pairs that a paragraph must hold.
MIN_SIMILARITY = 0.6

#: Notices by license family, as projects print them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice appear in all copies."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
]
#: What may stand between two words of a wrapped notice: no letter or digit, and a comment word.
_GAP = r"[^\p{L}\p{N}]+(?:(?:dnl|rem)[^\p{L}\p{N}]+)?"
#: A paragraph without any of these cannot hold a template; every template has one.
ANCHOR = "(?i)" + "|".join(x.replace(" ", _GAP) for x in (
    "licen[cs]", "all rights reserved", "permission", "redistribut", "public domain", "waived all copyright"))
#: Comment words that open a line (signs are dropped by ``words``).
LEADER = r"(?im)^[^\p{L}\p{N}\n]*(?:dnl|rem)(?![\p{L}\p{N}])"
#: Between two paragraphs: lines without a letter or digit (blank, or a comment sign alone).
BLANK = r"\n[^\p{L}\p{N}]*\n"
#: Words of a window and its step; no template is longer than a step, so each lies whole in a window.
SPAN, STEP = 80, 40


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; a number that is no version counts as 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?<![0-9.])[0-9]{3,}", "0"), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(plain), " "), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, block)``: the paragraphs of every text that hold an anchor,
    numbered from 0 over all. Paragraphs are parted by lines without a letter or
    digit; comment words that open a line are dropped. Null, empty and blank texts
    have none. A text without an anchor is passed over before it is cut."""
    plain = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), LEADER, "")
    blocks = docs.filter(F.col("text").rlike(ANCHOR)).select(
        "doc_id", F.posexplode(F.split(plain, BLANK)).alias("paragraph", "block"))
    return blocks.filter(F.col("block").rlike(ANCHOR))


def passages(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``words``, one row per passage that holds an anchor: each line
    alone, and the joined lines in windows of ``SPAN`` words, ``STEP`` apart."""
    lines = F.transform(F.filter(F.split("block", "\n"), lambda x: x.rlike(ANCHOR)), words)
    n = F.size("_all")
    starts = F.sequence(F.lit(0), F.greatest(n - STEP - 1, F.lit(0)), F.lit(STEP))
    windows = F.filter(F.transform(starts, lambda i: F.slice("_all", i + 1, SPAN)),
                       lambda w: F.array_join(w, " ").rlike(ANCHOR))
    every = blocks.withColumn("_all", words(F.col("block"))).withColumn("_lines", lines)
    return every.withColumn("words", F.explode(F.array_distinct(F.concat("_lines", windows)))).drop("_all", "_lines", "block")


def pairs(column: str) -> Column:
    """The distinct word pairs; the word itself where there is only one."""
    w = F.col(column)
    n = F.size(w)
    two = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.slice(w, i, 2)))
    return F.array_distinct(F.when(n >= 2, two).otherwise(w))


@dataclass
class Model:
    features: PipelineModel
    classifier: LogisticRegressionModel
    classes: list[str]
    thresholds: dict[str, float]


def _features() -> PipelineModel:
    """Words, word pairs and word triples, hashed to counts."""
    return PipelineModel(stages=[
        NGram(n=2, inputCol="words", outputCol="_w2"), NGram(n=3, inputCol="words", outputCol="_w3"),
        SQLTransformer(statement="SELECT *, concat(words, _w2, _w3) AS _grams FROM __THIS__"),
        HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="_grams", outputCol="_features")])


def templates(spark: SparkSession) -> DataFrame:
    """``(family, template, words)``."""
    t = spark.createDataFrame([(f, i, x) for i, (f, x) in enumerate(TEMPLATES)], "family string, template int, text string")
    return t.select("family", "template", words(F.col("text")).alias("words"))


def _examples(spark: SparkSession, docs: DataFrame, background: int) -> DataFrame:
    """``(family, words, held)``: every template whole, without its first or last
    words, and inside other words; and as ``unknown`` at most ``background`` lines
    of the corpus that hold no anchor, the first by a hash. ``held`` rows calibrate."""
    t = templates(spark)
    n = F.size("words")
    cuts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(z).alias("z")) for a in (0, 1, 2) for z in (0, 1, 2)])
    cut = (t.withColumn("c", F.explode(cuts)).filter((n - F.col("c.a") - F.col("c.z") >= 3) | (F.col("c.a") + F.col("c.z") == 0))
           .withColumn("words", F.slice("words", F.col("c.a") + 1, n - F.col("c.a") - F.col("c.z"))))
    around = F.array(F.array().cast("array<string>"), F.split(F.lit("copyright 0 the authors"), " "),
                     F.split(F.lit("see the file for details"), " "))
    seen = cut.withColumn("x", F.explode(around)).select("family", F.concat("x", "words").alias("words"))
    some = (docs.filter("text is not null and doc_id is not null").select("doc_id").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(background))                # ids alone are ranked
    lines = (docs.join(F.broadcast(some), "doc_id", "left_semi").select(F.explode(F.split("text", r"\r\n|[\n\r]")).alias("line"))
             .filter(~F.col("line").rlike(ANCHOR)).select(F.lit(UNKNOWN).alias("family"), words(F.col("line")).alias("words"))
             .filter(F.size("words") > 0).limit(background))
    stray = ["the license plate of the car", "a driving license is required", "please ask for permission first",
             "licensed under the terms of a private agreement", "the licence fee was paid", "permission was denied",
             "this text is licensed", "licensed under a custom license", "released under a license"]
    other = spark.createDataFrame([(UNKNOWN, x) for x in stray], "family string, text string").select(
        "family", words(F.col("text")).alias("words"))
    every = seen.unionByName(lines).unionByName(other.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("c"))
    return every.withColumn("held", F.pmod(F.xxhash64("words", F.lit("held")), F.lit(5)) == 0)


def train(spark: SparkSession, docs: DataFrame, background: int = 1_000, slack: float = 0.5) -> Model:
    """Fit on the templates and at most ``background`` background lines (the
    documented bound of the sample); the threshold of a family is ``slack`` times
    the least probability it gets on its own held-out notices."""
    rows = materialize(_examples(spark, docs, background), "license-examples")
    classes = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    features = _features()
    data = features.transform(rows).withColumn("label", label)
    data = materialize(data.select("family", "held", "label", "_features"), "license-features")
    taught = data.filter(~F.col("held"))
    size = taught.groupBy("label").agg(F.count(F.lit(1)).alias("n"))        # one row per class
    taught = taught.join(F.broadcast(size), "label").withColumn("weight", 100.0 / F.col("n"))
    fit = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", family="multinomial",
                             regParam=0.002, maxIter=60, standardization=False)
    classifier = fit.fit(taught)
    p = vector_to_array("probability")
    own = F.get(p, F.col("label").cast("int"))
    level = (classifier.transform(data).filter(F.col("held") & (F.col("family") != UNKNOWN))
             .groupBy("family").agg(F.min(own).alias("p")).collect())
    found = {r["family"]: r["p"] * slack for r in level}
    return Model(features, classifier, classes, {c: min(0.9, max(0.2, found.get(c, 0.5))) for c in classes[:-1]})


def scan(docs: DataFrame, m: Model) -> DataFrame:
    """``(doc_id, paragraph, family, predicted, probability, similarity)``: one row per
    family found in a paragraph that mentions a license (holds an anchor), or one
    ``unknown`` row where none is found.

    Every passage of the paragraph is classified. ``predicted`` is its most probable
    class; ``family`` is that class if it is above its calibrated threshold and a
    template of it is confirmed (``similarity``, the largest share of a template's
    word pairs in the passage), else ``unknown``. Of the passages of one family the
    most similar is shown. A null doc_id stays null; repeated rows are each scanned.
    """
    spark = docs.sparkSession
    blocks = materialize(paragraphs(docs).withColumn("_row", F.monotonically_increasing_id()), "license-paragraphs")
    rows = m.features.transform(passages(blocks).withColumn("pairs", pairs("words")))
    p = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in m.classes])
    scored = (m.classifier.transform(rows).withColumn("p", p)
              .withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
              .select("_row", "doc_id", "paragraph", "pairs", "predicted", F.array_max("p").alias("probability")))
    known = (templates(spark).withColumn("pairs", pairs("words")).groupBy("family")
             .agg(F.collect_list("pairs").alias("templates")).withColumnRenamed("family", "predicted"))
    level = F.coalesce(*[F.when(F.col("predicted") == c, F.lit(v)) for c, v in m.thresholds.items()], F.lit(2.0))
    share = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, "pairs")) / F.size(t)))
    out = scored.join(F.broadcast(known), "predicted", "left").withColumn("similarity", F.coalesce(share, F.lit(0.0)))
    sure = (F.col("probability") >= level) & (F.col("similarity") >= MIN_SIMILARITY)
    best = (out.withColumn("family", F.when(sure, F.col("predicted")).otherwise(UNKNOWN))
            .groupBy("_row", "doc_id", "paragraph", "family")
            .agg(F.max(F.struct("similarity", "probability", "predicted")).alias("b")))
    # a paragraph's rows: its families, or unknown
    found = best.groupBy("_row", "doc_id", "paragraph").agg(F.collect_list(F.struct("family", "b")).alias("f"))
    some = F.filter("f", lambda x: x["family"] != UNKNOWN)
    return found.select("doc_id", "paragraph", F.explode(F.when(F.size(some) > 0, some).otherwise(F.col("f"))).alias("x")).select(
        "doc_id", "paragraph", "x.family", "x.b.predicted", "x.b.probability", "x.b.similarity")
