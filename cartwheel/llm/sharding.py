"""Sharding by longest-processing-time scheduling.

Rows with equal texts are a group and stay together. Groups, largest first, go to
the least-loaded shard through a heap. The heap runs over a histogram of group
sizes of bounded length instead of the groups: all sizes of 1 part in 256 share
a class, a class is dealt at its mean size, and its groups, numbered in parallel,
take their shards from the class's quotas. Where classes hold one size each, that
is the schedule of the heap over the groups themselves.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import fresh, quoted

SHARDS = 40
OVERHEAD = 16
#: Rows per numbering bucket.
BUCKET = 50_000


def size_class(size: Column, lead_bits: int = 9) -> Column:
    """Class of a size: the size itself below 2 ** ``lead_bits`` (512), beyond it its leading
    bits. Larger sizes have larger classes; at most 2 ** ``lead_bits`` / 2 (256) per power of two."""
    bits = F.length(F.bin(size))
    e = F.greatest(bits - lead_bits, F.lit(0)).cast("int")
    lead = F.floor(size / F.pow(F.lit(2.0), e.cast("double"))).cast("long")
    return e.cast("long") * 2 ** lead_bits + lead


def deal(classes: list[tuple[int, int, float]], shards: int) -> list[tuple[int, int, int, int]]:
    """``(class, shard, first, last)``: which run of a class's numbers goes to which
    shard. ``classes``: (class, groups, mean size), largest size first. Equal
    sizes dealt by a heap fill the lowest shards to a common level; the level is
    found by bisection, the last few go through the heap."""
    load, out = [0.0] * shards, []
    for key, n, mean in classes:
        quota = [0] * shards
        if n > 4 * shards:
            low, high = min(load), max(load) + n * mean / shards
            for _ in range(100):
                mid = (low + high) / 2
                if sum(int(max(0.0, mid - x) // mean) for x in load) <= n:
                    low = mid
                else:
                    high = mid
            quota = [int(max(0.0, low - x) // mean) for x in load]
        heap = [(load[s] + quota[s] * mean, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - sum(quota)):
            x, s = heapq.heappop(heap)
            quota[s] += 1
            heapq.heappush(heap, (x + mean, s))
        first = 0
        for s in range(shards):
            if quota[s]:
                out.append((key, s, first, first + quota[s] - 1))
                first += quota[s]
                load[s] += quota[s] * mean
    return out


def numbered(df: DataFrame, within: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with a gapless number from 0 per value of ``within``, without a task
    that sees a whole value: rows fall into hash buckets, are numbered there, and
    shifted by the counts of the buckets before. ``df`` must be a stored table."""
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = b.groupBy(*within, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order)) - 1
    keys = [*within, "_b"]
    return (b.withColumn("_local", local).join(starts, keys)
            .withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_b", "_local", "_start"))


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, row_key: str | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs``, after them its
    column ``row_key`` if one is named.

    Size is the UTF-8 length of the text (null: 0) plus ``overhead``. Rows with
    equal texts share a shard; rows with null text are one group, rows with empty
    text another. Slots number the rows of a shard from 0 without gaps. Ties in
    size are broken by a hash of the text, so reruns agree. An empty table gives
    no rows. A group is told by md5, crc32 and length of its text.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(overhead)
    carried = [row_key] if row_key else []
    rows = materialize(docs.select(
        "doc_id", *carried, size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")).alias("_md5")), "shard-rows")
    key = ["_md5", "_crc", "_one"]
    rows = rows.withColumn("_crc", F.coalesce("text_crc32", F.lit(-1))).withColumn("_one", F.col("size"))
    groups = rows.groupBy(*key).agg(F.sum("size").alias("total")).withColumn("class", size_class(F.col("total")))
    groups = materialize(groups, "shard-groups")
    histogram = (groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"))
                 .orderBy(F.desc("class")).collect())
    n_groups = sum(r["n"] for r in histogram)
    runs = deal([(r["class"], r["n"], r["t"] / r["n"]) for r in histogram], shards)
    buckets = max(1, -(-n_groups // BUCKET))
    spark = docs.sparkSession
    quotas = spark.createDataFrame(runs, "class long, shard int, first long, last long")
    number = numbered(groups, ["class"], ["total", *key], "number", buckets)
    # at most one run per shard of each class: folded to an array, so the join below is by equal class
    folded = quotas.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("last", "shard"))).alias("runs"))
    at = F.filter("runs", lambda r: r["last"] >= F.col("number"))[0]["shard"]
    placed = number.join(F.broadcast(folded), "class").select(*key, at.alias("shard"))
    out = materialize(rows.join(placed, key).select("doc_id", "size", "text_crc32", "_md5", "shard", *carried), "shard-placed")
    n = out.count()
    out = numbered(out, ["shard"], ["doc_id", "size", "_md5"], "slot", max(1, -(-n // BUCKET)))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *carried)


def shard_rows(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` of ``shard`` behind its own columns,
    every row once, also where ids repeat or are null. A column of ``docs`` with one of these
    names stays, the new one has an underscore in front. Texts are kept aside while the
    shards are dealt and meet their shard by a stored row key.
    """
    key = fresh(docs, "_row")
    stored = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "shard-texts")
    new = ["size", "text_crc32", "shard", "slot"]
    dealt = shard(stored, shards, overhead, row_key=key).select(key, *[F.col(c).alias(fresh(docs, c)) for c in new])
    return stored.join(dealt, key).select(*quoted(docs), *[fresh(docs, c) for c in new])
