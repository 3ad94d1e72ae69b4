"""A corpus pipeline over ``documents``: each stage's result is written as Parquet in
the shared folder and read back as the next one's input.

    toxicity -> SimHash near-dedup -> benchmark decontamination -> source mixing -> sharding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.llm import decontamination, mixing, queries, sharding, simhash, toxicity
from cartwheel.llm.common import fresh, quoted, table
from cartwheel.session import materialize

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below ``TOXIC_FROM``, each row by its own whole text: null, empty and
    blank texts by the model's bias, repeated rows alike. Columns stay as they are, also one
    named ``toxicity``; an empty table stays empty."""
    mark = fresh(docs, "toxicity")
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir), into=mark)
    return scored.filter(F.col(mark) < TOXIC_FROM).select(quoted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id (of several rows of
    that id, the one of least hash). Null, empty and blank texts are one group; rows without
    an id stay; whole texts of any length count; an empty table stays empty."""
    groups = simhash.near_duplicates(docs, shingle=4, max_bits=4)
    return simhash.keep_one(docs, groups)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Rows of one id are judged together; null and empty
    texts and rows without an id stay; an empty table stays empty."""
    leaked = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(quoted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; rows of one id are taken alike, texts without
    words have size 0 and follow their source's rate; the null source is a source."""
    return mixing.emit(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, text included, with its shard and slot; equal texts (null texts too) share a shard,
    repeated rows have slots of their own; an empty table gives no rows. Columns named size,
    text_crc32, shard or slot stay as they are, the stage's own then begin with an underscore."""
    return sharding.shard_rows(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_leaks),
          ("mix_sources", mix_sources), ("sharding", assign_shards)]

ORACLE_SQL = None  # a trained classifier, fingerprints and a heap schedule: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
