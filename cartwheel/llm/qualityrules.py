"""Quality rules with adaptive thresholds.

Every text is measured in its own row: words, characters, symbols, repeated lines and
repeated word windows. Four integer rates of a text (thousandths) are summarised per
(language, source) in mergeable quantile sketches; fences around the middle half of each
rate replace fixed cutoffs, and a join brings them back to the documents.

A sketch is a histogram whose buckets keep the leading ``SKETCH_BITS`` bits of a value, so
a quantile is off by less than one part in 2 ** (SKETCH_BITS - 1). It is a table of
(language, source, rule, bucket, count): partial sums are the sketch of a partition, sums
over sources that of a language, sums over everything that of the corpus. It has a bounded
number of rows per group and is the same on every run, whatever the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SKETCH_BITS = 8
#: A group of fewer texts takes the fences of its language, or else of the corpus.
MIN_GROUP = 200
#: A fence lies this many spreads outside the middle half.
SPREADS = 3
#: The rates, each with the least spread counted (thousandths) and whether low values are odd too.
RULES = {"word_length": (500, True), "symbols": (250, False), "dup_lines": (150, False), "repeat_words": (100, False)}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also if it is read in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words of the array ``w`` that lie in a window of three words found twice or more.

    Windows are told by a hash of 64 bits. Where some are equal they are sorted by hash and
    place; equal neighbours are repeats, and the union of their stretches is summed in order
    of place."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(s: Column) -> Column:
        kept = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        stretch = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(stretch, F.lit(0).cast("long"), lambda a, x: a + x)

    def found(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                .otherwise(let(placed, lambda s: let(twice(s), covered))))

    return F.when(F.size(w) >= 4, let(hashes, found)).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """The counts of one text as a struct of longs; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    by_word = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeats")))
    chars = F.length(t) - F.regexp_count(t, F.lit(SPACE))
    found = F.struct(by_word.alias("words"), by_line.alias("lines"), chars.alias("chars"),
                     F.regexp_count(t, F.lit(SYMBOL)).alias("symbols"))
    return let(found, lambda x: F.struct(*[c.cast("long").alias(n) for n, c in {
        "n_words": x["words"]["n"], "word_chars": x["chars"], "n_symbols": x["symbols"], "n_lines": x["lines"]["n"],
        "n_dup_lines": x["lines"]["repeats"], "n_repeat_words": x["words"]["repeats"]}.items()]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rate(rule: str) -> Column:
    """A rate of a measured text in thousandths (long, rounded down); 0 without words."""
    part, whole = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
                   "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words")}[rule]
    return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0).cast("long"))


def bucket(value: Column) -> Column:
    """The least value that shares the leading bits of ``value`` (long, 0 or more)."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0)))
    return value - F.pmod(value, unit)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with its counts and ``base_failed``."""
    counted = docs.select(*keep, counts(F.col("text")).alias("_c")).select(*keep, "_c.*")
    return counted.withColumn("base_failed", base_failed())


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, count) over the texts that pass the base rules."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), bucket(rate(r)).alias("bucket")) for r in RULES])
    return (measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("v"))
            .groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("count")))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts of equal buckets are added."""
    return sketches.groupBy(*by, "rule", "bucket").agg(F.sum("count").alias("count"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rule, total, low, high): the quartiles of each sketch, moved outwards."""
    group = Window.partitionBy(*by, "rule")
    below = F.sum("count").over(group.orderBy("bucket"))
    ranked = sketches.select(*by, "rule", "bucket", below.alias("upto"), F.sum("count").over(group).alias("total"))
    q = ranked.groupBy(*by, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for r, (n, _) in RULES.items() for x in (r, n)]), F.col("rule"))
    two_sided = F.col("rule").isin([r for r, (_, low) in RULES.items() if low])
    reach = SPREADS * F.greatest(F.col("q3") - F.col("q1"), least)
    return q.select(*by, "rule", "total", F.when(two_sided, F.col("q1") - reach).otherwise(F.lit(0)).alias("low"),
                    (F.col("q3") + reach).alias("high"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, limits map<rule, struct<low, high>>) for every (lang, source) of the
    sketches: its own fences from ``MIN_GROUP`` texts on, else those of its language, from
    as many texts on, else those of all texts."""
    own, every = fences(sketches, ["lang", "source"]), fences(merge(sketches, []), [])
    lang = fences(merge(sketches, ["lang"]), ["lang"]).select(F.col("lang").alias("_lang"), F.col("rule").alias("_rule"),
                                                              F.struct("total", "low", "high").alias("l"))
    every = every.select(F.col("rule").alias("_any"), F.struct("total", "low", "high").alias("e"))
    j = (own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("rule") == F.col("_rule")))
         .join(every, F.col("rule") == F.col("_any")))
    limit = (F.when(F.col("total") >= MIN_GROUP, F.struct("low", "high"))
             .when(F.col("l.total") >= MIN_GROUP, F.struct("l.low", "l.high")).otherwise(F.struct("e.low", "e.high")))
    return j.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", limit.alias("limit")))).alias("limits"))


def within(limits: str = "limits") -> Column:
    """Whether every rate of a measured text lies inside its group's fences (false without fences)."""
    ok = F.lit(True)
    for r in RULES:
        at = F.element_at(limits, r)
        ok = ok & rate(r).between(at["low"], at["high"])
    return F.coalesce(ok, F.lit(False))


def with_limits(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``limits`` of its (lang, source), null keys meeting null keys. A hot
    group is no skew: the fences are broadcast where small, else Spark splits its partition."""
    t = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    return measured.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")),
                         "left").drop("_lang", "_source")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the ``COUNTS``, base_failed, kept) for every row of ``docs``.

    Null, empty and blank texts have no words, so they fail the base rules; very long texts
    are measured whole. Null languages and sources are groups of their own. Repeated rows
    are judged alike, each counting in the sketches. An empty table gives no rows; other
    columns of ``docs`` are not read."""
    m = materialize(measure(docs, ["doc_id", "lang", "source"]), "quality-counts")
    found = with_limits(m, thresholds(materialize(sketch(m), "quality-sketches")))
    return found.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & within()).alias("kept"))


def keep(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and their fences (``thresholds``), with
    their columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    m = measure(docs.select(row, "text", "lang", "source"), ["row", "lang", "source"])
    return with_limits(m, limits).filter(~F.col("base_failed") & within()).select("row.*")
