"""Mixing sources to target weights.

Tokens are summed per source; targets follow from the sources' weights by water
filling under a cap on repetition; a document of a source with repetition rate r is
taken floor(r) times, plus once more with probability r - floor(r) = f. The draw is
systematic: a source's documents stand in order of size and, among like sizes, of a
hash of the id and a seed; the i-th is taken once more where i * f plus a hash-seeded start
passes a whole number. Every document has probability f, and a source's words
miss its target by no more than about its largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .common import WORD, quoted
from .sharding import size_class

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = "mix"
#: Leading bits in which sizes of one class agree: they differ by less than 1 part in 32.
LEAD_BITS = 6


def word_count(text: str = "text") -> Column:
    """Words of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame, size: str = "size") -> DataFrame:
    """``(source, source_size)``, the null source as a source of its own."""
    return docs.groupBy("source").agg(F.sum(size).alias("source_size"))


def weigh(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds ``weight``: sources by code point, null last, take the weights in turn.
    The table has one row per source (already aggregated)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("weight", F.element_at(values, F.pmod(place, F.lit(len(weights))).cast("int") + 1))


def targets(weighed: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``target`` and ``rate`` (target / size, at most ``cap``): the whole of all
    sizes is shared by weight, a target stops at ``cap`` times its source's size, and
    the excess is reshared by weight until no target is above.

    Each round is one small sum per source table; the level only rises, so a source
    once capped stays capped. Sources without tokens get target 0 and rate 0.
    """
    weighed = materialize(weighed, "sources")
    limit = F.col("source_size") * F.lit(float(cap))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        r = weighed.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("full"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (float(total) - (r["full"] or 0.0)) / r["open"] if r["open"] else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), limit)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return weighed.withColumn("target", target).withColumn("rate", rate)


def coin(value: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and value; reruns and both engines agree."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_key(source: str = "source") -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))


def placed(units: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``place``, the number from 1 of each unit in its source: larger classes of ``words``
    first, then by coin, id and size. ``units`` is a stored table.

    No task sees a whole source: a stratum (source, class) of n units is cut at the coin
    into about sqrt(n) ranges, numbered apart and shifted by the counts before them.
    """
    stratum = ["key", "class"]
    u = units.withColumn("key", source_key()).withColumn("class", size_class(F.col("words"), LEAD_BITS)).withColumn(
        "coin", coin(F.col("doc_id"), seed))
    larger = Window.partitionBy("key").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    strata = (u.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("larger", F.coalesce(F.sum("n").over(larger), F.lit(0)))
              .withColumn("ranges", F.ceil(F.sqrt("n"))).drop("n"))
    u = u.join(strata, stratum).withColumn("range", F.floor(F.col("coin") * F.col("ranges")))
    span = [*stratum, "range"]
    earlier = Window.partitionBy(*stratum).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (u.groupBy(*span).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    local = F.row_number().over(Window.partitionBy(*span).orderBy("coin", F.asc_nulls_last("doc_id"), "size"))
    return (u.withColumn("local", local).join(starts, span)
            .withColumn("place", F.col("larger") + F.col("start") + F.col("local"))
            .select(*units.columns, "key", "place"))


def copies(rate: Column, place: Column, start: Column) -> Column:
    """floor(rate), plus one where place * fraction + start passes a whole number."""
    f = rate - F.floor(rate)
    return (F.floor(rate) + F.floor(place * f + start) - F.floor((place - 1) * f + start)).cast("long")


def with_rates(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """``docs`` with the columns of its source; null sources meet the null source.
    A hot source is no skew: the source table goes to the documents by AQE's
    broadcast, or, where sources are many, the join splits its partition."""
    s = sources.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    return docs.join(s, docs["source"].eqNullSafe(s["_source"]), "left").drop("_source")


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size)`` of every row, stored."""
    return materialize(docs.select("doc_id", "source", word_count().alias("size")), "sizes")


def decisions(sized: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``(unit_source, unit_id, unit_size, source_size, target, rate, copies)``: rows of one source,
    id and size are a unit and taken alike; a unit's place follows from the words of all its rows."""
    sources = targets(weigh(source_sizes(sized), weights), cap)
    units = sized.groupBy("source", "doc_id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("words"))
    rated = with_rates(placed(materialize(units, "units"), seed), sources)
    n = copies(F.col("rate"), F.col("place"), coin(F.col("key"), seed))
    return rated.select(F.col("source").alias("unit_source"), F.col("doc_id").alias("unit_id"),
                        F.col("size").alias("unit_size"), "source_size", "target", "rate", n.alias("copies"))


def with_decisions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows(source, doc_id, size, ...)`` with the columns of their unit. An id on many rows is one
    row of ``decided``; its partition of ``rows`` is split by AQE."""
    same = (rows["source"].eqNullSafe(decided["unit_source"]) & rows["doc_id"].eqNullSafe(decided["unit_id"])
            & (rows["size"] == decided["unit_size"]))
    return rows.join(decided, same).drop("unit_source", "unit_id", "unit_size")


def decide(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies)`` for every row of ``docs``.

    Null, empty and blank texts have size 0 and stand last in their source; the null source is a
    source; repeated rows and rows without an id are taken alike where their sizes are equal;
    an empty table gives no rows.
    """
    sized = sizes(docs)
    return with_decisions(sized, decisions(sized, weights, cap, seed))


def emit(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``decide`` takes it. Columns stay
    as they are."""
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), "source", "doc_id", word_count().alias("size"))
    taken = with_decisions(rows, decisions(sizes(docs), weights, cap, seed)).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
