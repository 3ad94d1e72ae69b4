"""The registered queries of the training-data operators, ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (covertree, decontamination, langid, licenses, lmscore, mixing, qualityrules, runs, sharding, simhash, toxicity,
               urlfilter, whitening)
from .common import crc_mod, table

BLOCK_LISTS = ["ads", "malware"]
ALLOW_LISTS = ["allow"]


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in input: the pages with a fetch date (the tables have none), spread over
    four years from the id."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(1461)).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in input: dated list entries (the tables have none) naming hosts and first
    path segments of every third page, on days and with actions from the id."""
    part = F.split("url", "/")
    pages = table(spark, sf_dir, "pages").filter("page_id % 3 = 0 and url is not null").select(
        "page_id", F.get(part, 2).alias("host"), F.split(F.get(part, 3), "[?#]")[0].alias("first"))
    n = F.floor(F.col("page_id") / 3)
    kind = F.when(F.pmod(n, F.lit(4)) == 3, "url").otherwise("domain")
    return pages.select(
        F.element_at(F.array(*[F.lit(x) for x in [*BLOCK_LISTS, *ALLOW_LISTS]]), F.pmod(n, F.lit(3)).cast("int") + 1).alias("list"),
        kind.alias("kind"),
        F.when(kind == "url", F.concat_ws("/", "host", "first")).otherwise(F.col("host")).alias("value"),
        F.date_add(F.lit("2019-06-01").cast("date"), F.pmod(n * 613, F.lit(1600)).cast("int")).alias("day"),
        F.when(F.pmod(n, F.lit(5)) >= 3, "remove").otherwise("add").alias("action"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active on its fetch date."""
    return urlfilter.judge(captures(spark, sf_dir), list_entries(spark, sf_dir), BLOCK_LISTS, ALLOW_LISTS).select(
        F.col("capture_id").alias("page_id"), "fetched", "n_active", "rule", "blocked")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every vector whose id is divisible by 50."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"),
                                                  covertree.quantized("embedding").alias("v"))
    return covertree.top_k(v, v.filter("vec_id % 50 = 0"), k=5)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Trained on the labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and decision of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    d = mixing.decide(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(crc_mod("doc_id", 3) != 1))
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; copies share a shard, bytes are balanced."""
    s = sharding.shard(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License families of every paragraph of a document that mentions a license."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(spark, docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, as it stands or re-parameterised."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by counts over all documents."""
    return lmscore.score(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether it lies inside the fences of its group."""
    return qualityrules.judge(table(spark, sf_dir, "documents"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Stand-in input: with h the crc32 of the id and n words, every tenth document (h divisible
    by 10) repeats from word a = floor(h / 10) mod n on the p words found there. Null ids
    stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return qualityrules.let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.concat_ws(" ", F.transform(
            w, lambda c, i: F.when(i < x["a"], c).otherwise(F.get(w, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))))))

    changed = qualityrules.let(qualityrules.words(F.col("text")), lambda w: F.when(F.size(w) > 0, tail(w)))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(changed, F.col("text")))
                       .otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the longest one, and digests of all and of what is left."""
    found = runs.find_runs(repeated_tails(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("_m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_m.before")).alias("start"), F.col("_m.length").alias("length"),
        (-F.col("_m.shorter")).alias("period"), F.floor(1000 * F.col("_m.length") / -F.col("_m.shorter")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


COMPONENTS = 8


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first whitened coordinates of every embedding in whole-number units, with the
    squared deviation from the mean and the quality of the whitening.

    Vectors that are null, empty, of an uncommon length, or that hold a null, non-finite or
    huge (2 ** 42) entry take no part. A deviation beyond a long is null."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = whitening.same_size(v.filter(whitening.usable("embedding", -2.0 ** 42, 2.0 ** 42)), "embedding")
    x = v.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024) + F.lit(100_000)).alias("x"))
    model = whitening.fit(x, "x")
    error = whitening.identity_error(x, "x", model, COMPONENTS)
    n, sums = F.lit(model.n).cast("long"), F.array(*[F.lit(int(s)).cast("long") for s in model.sums])

    def square(c):
        return F.try_multiply(c, c)

    apart = F.zip_with("x", sums, lambda a, s: square(F.try_subtract(F.try_multiply(n, a), s)))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), F.try_add)
    explained = F.array(*[F.lit(float(e / model.variance)) for e in model.eigenvalues[:COMPONENTS]])
    rows = x.select("vec_id", deviation.alias("deviation"), "x")
    out = whitening.whiten(rows, ["vec_id", "deviation"], "x", model, COMPONENTS)
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), n.alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_exact_topk, op3_simhash, op4_toxicity, op5_mix_sources, op6_language_id, op7_sharding,
    op8_license_scan, op9_decontamination, op10_lm_score, op11_quality_rules, op12_periodic_runs, op13_whitening)}
