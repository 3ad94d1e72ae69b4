"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: the longest run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: The columns of ``documents``, in order.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark only, so any path Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_column: str, n: int) -> Column:
    """crc32 of the id written as text, mod n (null id: the text ``null``)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("null"))), F.lit(n))


def parallelism(spark: SparkSession) -> int:
    """Reduce-side partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
