"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so that a question with
other figures has the same template. Every text has three token forms: two templates,
of capitalised words inside a sentence and of all capitalised words as names, and its
raw tokens. Windows of tokens are hashed and joined between documents and benchmark
items within each form; every alignment found is then compared token by token over
the whole item, together with the nearby shifts, and its slots must map consistently:
one value of the item always stands for one value of the document.

All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WINDOW = 8
#: Template tokens of a window that must be words, not placeholders.
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
#: Shifts to both sides of an alignment that count for it, and the run of tokens they must repeat.
REACH = 8
MIN_RUN = 4
#: Rows (two longs each) up to which the distinct benchmark windows may be broadcast.
BROADCAST_WINDOWS = 1_000_000

#: Units of measure and money.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "lb", "oz", "ml", "l", "inch", "inches", "feet", "ft", "miles",
         "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "pounds", "liters", "litres",
         "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent",
         "kmh", "mph", "celsius", "fahrenheit"]
_CAP = r"\p{Lu}\p{Ll}\p{L}*+"
#: Names: runs of capitalised words inside a sentence, or anywhere.
NAME_RE = rf"(?<=[\p{{L}}\p{{N}},;] ){_CAP}(?:[,;]? {_CAP})*+"
CAPITAL_RE = rf"(?<![\p{{L}}\p{{N}}]){_CAP}(?:[,;]? {_CAP})*+"
UNIT_RE = r"(?<=[0-9%])[\x20\x09]?(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_NUMBER = r"[$€£]?[0-9]+(?:[.,:/][0-9]+)*+%?"
#: Placeholder tokens: single private-use characters (in a text they read as a slot without a value).
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Runs of numbers with nothing but signs between them.
NUMBER_RE = rf"{_NUMBER}(?:[^\p{{L}}\p{{N}}{NAME}-{UNIT}]+{_NUMBER})*+"
#: The words and numbers of a slot's value.
PART_RE = rf"\p{{L}}+|{_NUMBER}"
#: Token forms: the pattern of names, or none for raw tokens.
RAW = 2
FORMS = {0: NAME_RE, 1: CAPITAL_RE, RAW: None}


def canonical(text: Column, name_re: str = NAME_RE) -> tuple[Column, Column, Column, Column]:
    """The text in four states: as it is, with names, then units, then numbers
    replaced. A name is a run of capitalised words, by default inside a sentence
    (after a word, comma or semicolon and one space); a unit follows a number."""
    t0 = F.coalesce(text, F.lit(""))
    digits = t0.rlike("[0-9]")
    t1 = F.regexp_replace(t0, name_re, f" {NAME} ")
    t2 = F.regexp_replace(t1, UNIT_RE, f" {UNIT} ")
    t3 = F.when(digits, F.regexp_replace(t2, NUMBER_RE, f" {NUMBER} ")).otherwise(t1)
    return t0, t1, t2, t3


def template(text: Column, form: int = 0) -> Column:
    """Tokens of a form: runs of letters, digits and placeholders, lower-cased; raw
    tokens carry their values. The first and last token may be empty (no item token is)."""
    if form == RAW:
        return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.split(F.lower(canonical(text, FORMS[form])[3]), rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}]+")


def _with_slots(df: DataFrame, form: int) -> DataFrame:
    """``df(text)`` with ``form``, ``t`` and the values replaced, in order, per placeholder."""
    df = df.withColumn("form", F.lit(form)).withColumn("t", template(F.col("text"), form))
    if form == RAW:
        return df.withColumns({c: F.array().cast("array<string>") for c in ("names", "units", "numbers")})
    t0, t1, t2, _ = canonical(F.col("text"), FORMS[form])
    whole = F.lit(0)
    return (df.withColumn("names", F.regexp_extract_all(t0, F.lit(FORMS[form]), whole))
            .withColumn("units", F.regexp_extract_all(t1, F.lit(UNIT_RE), whole))
            .withColumn("numbers", F.regexp_extract_all(t2, F.lit(NUMBER_RE), whole)))


def _values(prefix: str) -> Column:
    """The placeholders of ``<prefix>t`` as ``(i, type, parts)``."""
    t = F.col(f"{prefix}t")

    def of(kind: str, column: str) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: t[i] == kind)
        value = F.zip_with(at, F.col(f"{prefix}{column}"), lambda i, v: F.struct(
            i.alias("i"), F.lit(kind).alias("type"),
            F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit(PART_RE), F.lit(0)).alias("parts")))
        return F.filter(value, lambda x: x["i"].isNotNull())

    return F.concat(of(NAME, "names"), of(UNIT, "units"), of(NUMBER, "numbers"))


def _windows(tokens: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``(*keep, at, h)``: every window of ``size`` tokens of ``tokens(*keep, t)`` by its
    hash. The positions are exploded and the hash is taken from the array in place,
    within generated code."""
    # no filter on the size: pushed below the projection, it would tokenise every text twice
    starts = F.when(F.size("t") >= size, F.sequence(F.lit(0), F.size("t") - size))
    at = tokens.select(*keep, "t", F.explode(starts).alias("at"))
    return at.select(*keep, "at", F.xxhash64(*[F.get("t", F.col("at") + i) for i in range(size)]).alias("h"))


def _gapped(tokens: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``(*keep, at, h)``: every ``size`` tokens in a row, and every ``size + 1`` without
    one of the inner ones. Two such windows are equal where one token was put in,
    left out or replaced."""
    starts = F.when(F.size("t") >= size, F.sequence(F.lit(0), F.size("t") - size))
    at = tokens.select(*keep, "t", F.explode(starts).alias("at"))
    full = F.xxhash64(*[F.get("t", F.col("at") + i) for i in range(size)])
    inner = [F.when(F.col("at") + size < F.size("t"),
                    F.xxhash64(*[F.get("t", F.col("at") + i) for i in range(size + 1) if i != gap]))
             for gap in range(1, size)]
    return at.select(*keep, "at", F.explode(F.array(full, *inner)).alias("h")).filter("h is not null")


def _literals(start: Column, size: int) -> Column:
    return F.size(F.filter(F.slice("t", start, size), lambda x: ~x.isin(NAME, NUMBER, UNIT)))


def _hashed(tokens: DataFrame, keep: list[str], w: int) -> DataFrame:
    """Windows of ``w`` tokens; gapped windows of ``-w`` tokens where w is negative."""
    return (_windows(tokens, keep, w) if w > 0 else _gapped(tokens, keep, -w)).withColumn("w", F.lit(w))


def alignments(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, form, shift, size, coverage, exact, consistent)``: one row per
    document, item, form and shift (token position in the document less that in the
    item) that share a window.

    Coverage is the share of the item's ``size`` tokens that the document repeats in
    place, or at up to ``REACH`` other shifts to both sides in runs of ``MIN_RUN``
    tokens (of two, in items of fewer than two windows). ``exact``: the covered tokens have equal values; ``consistent``: no value
    of the item's slots stands for two values of the document. Raw tokens count in
    runs of a window only. Items of fewer than ``window`` tokens are matched as one
    window of their length, and items of at most ``window`` tokens, in the templates,
    also with one token put in, left out or replaced. Items of fewer than four tokens,
    and template windows of fewer than four words that are no placeholders, are no
    evidence and match nothing. Null texts have no tokens; rows without id are left
    out; repeated rows count once.
    """
    texts = items.filter("item_id is not null").select("item_id", "text").distinct()
    bench = _with_slots(texts, 0)
    for form in list(FORMS)[1:]:
        bench = bench.unionByName(_with_slots(texts, form))
    n = F.size("t")
    small = (F.col("form") != RAW) & n.between(MIN_LITERALS + 1, window)
    bench = bench.withColumn("t", F.filter("t", lambda x: x != "")).filter(n >= MIN_LITERALS)
    bench = materialize(bench.withColumn("w", F.array_compact(F.array(
        F.least(n, F.lit(window)), F.when(small, 1 - n)))), "benchmark")
    sizes = sorted((r["form"], r["w"]) for r in bench.select("form", F.explode("w").alias("w")).distinct().collect())
    windows = bench.select("form", F.lit(0).alias("w"), F.lit(0).cast("long").alias("h"), "item_id",
                           F.lit(0).alias("item_at")).limit(0)                  # at most 2 * `window` sizes a form
    for form, w in sizes:
        of = bench.filter((F.col("form") == form) & F.array_contains("w", w)).select("form", "item_id", "t")
        full = _hashed(of, ["form", "item_id", "t"], w)
        if form != RAW:                                     # a gapped window reaches over one token more
            full = full.filter(_literals(F.col("at") + 1, w if w > 0 else 1 - w) >= MIN_LITERALS + (w < 0))
        windows = windows.unionByName(full.select("form", "w", "h", "item_id", F.col("at").alias("item_at")).distinct())
    windows = materialize(windows, "benchmark-windows")
    known = windows.select("form", "w", "h").distinct()
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)

    own_docs = docs.filter("doc_id is not null and text is not null")
    found = windows.select("form", "w", "h", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("at")).limit(0)
    for form, w in sizes:
        tokens = own_docs.select("doc_id", template(F.col("text"), form).alias("t"))
        own = _hashed(tokens, ["doc_id"], w).withColumn("form", F.lit(form))
        found = found.unionByName(own.join(known, ["form", "w", "h"], "left_semi").select("form", "w", "h", "doc_id", "at"))
    found = materialize(found, "window-hits")
    pairs = (found.join(windows, ["form", "w", "h"])
             .select("doc_id", "item_id", "form", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    pairs = materialize(pairs, "alignments")

    slots = ["t", "names", "units", "numbers"]
    d = None
    for form in FORMS:
        some = docs.join(pairs.filter(F.col("form") == form).select("doc_id").distinct(), "doc_id", "left_semi")
        of = _with_slots(some.select("doc_id", "text").distinct(), form)
        of = of.select("doc_id", "form", *[F.col(c).alias(f"d_{c}") for c in slots])
        d = of if d is None else d.unionByName(of)
    d = d.withColumn("d_slots", _values("d_")).select("doc_id", "form", "d_t", "d_slots")
    b = bench.select("item_id", "form", *[F.col(c).alias(f"b_{c}") for c in slots])
    b = b.withColumn("b_slots", _values("b_")).select("item_id", "form", "b_t", "b_slots")
    out = pairs.join(b, ["item_id", "form"]).join(d, ["doc_id", "form"])

    n = F.size("b_t")
    place = F.sequence(F.lit(0), n - 1)
    shift = F.col("shift")
    raw = F.col("form") == RAW
    run = F.least(n, F.when(raw, F.lit(window)).when(n < 2 * window, 2).otherwise(MIN_RUN))
    near = F.array(*[F.lit(x) for x in sorted(range(-REACH, REACH + 1), key=abs)])
    # by element, not by slices of d_t: a slice copies the whole document
    hits = F.transform(near, lambda by: F.filter(place, lambda i: F.coalesce(
        F.get("d_t", i + shift + by) == F.get("b_t", i), F.lit(False))))
    out = out.withColumn("hits", hits).withColumn("run", run)

    def held(of: Column, rank: Column) -> Column:
        """The places ``of`` one shift that lie in a run; ascending, so a run's last is its first + run - 1."""
        run = F.col("run")
        first = F.filter(of, lambda j, k: F.coalesce(F.get(of, k + run - 1) == j + run - 1, F.lit(False)))
        places = F.array_distinct(F.flatten(F.transform(first, lambda j: F.sequence(j, j + run - 1))))
        by = shift + F.get(near, rank)
        return F.transform(places, lambda i: F.struct(i.alias("i"), rank.alias("rank"), by.alias("by")))

    place_here = F.transform(F.get("hits", F.lit(0)), lambda i: F.struct(i.alias("i"), F.lit(2 * REACH + 1).alias("rank"), shift.alias("by")))
    out = out.withColumn("alone", F.when(raw, F.array().cast("array<struct<i:int,rank:int,by:int>>")).otherwise(place_here))
    out = out.withColumn("every", F.array_sort(F.concat(F.flatten(F.transform("hits", held)), "alone")))
    # of each position the nearest shift
    out = out.withColumn("united", F.filter("every", lambda x, k: (k == 0) | (
        F.get("every", F.greatest(k - 1, F.lit(0)))["i"] != x["i"])))

    def parts(x: Column, s: Column, last: Column) -> Column:
        """The document's value; at the item's ends only as much as the item has."""
        k = F.size(s["parts"])
        more = F.size(x["parts"]) > k
        return (F.when(more & (s["i"] == 0), F.slice(x["parts"], F.size(x["parts"]) - k + 1, k))
                .when(more & (s["i"] == last), F.slice(x["parts"], 1, k)).otherwise(x["parts"]))

    def pair(s: Column, x: Column) -> Column:
        """``(type, b, d)`` part by part, or whole if the numbers of parts differ."""
        of = parts(x, s, n - 1)
        whole = F.array(F.struct(s["type"].alias("type"), F.array_join(s["parts"], " ").alias("b"), F.array_join(of, " ").alias("d")))
        each = F.zip_with(s["parts"], of, lambda v, w: F.struct(s["type"].alias("type"), v.alias("b"), w.alias("d")))
        return F.when(F.size(s["parts"]) == F.size(of), each).otherwise(whole)

    def met(places: str) -> Column:
        return F.array_distinct(F.flatten(F.flatten(F.transform("b_slots", lambda s: F.flatten(F.transform(
            F.filter(places, lambda u: u["i"] == s["i"]), lambda u: F.transform(
                F.filter("d_slots", lambda x: (x["i"] == s["i"] + u["by"]) & (x["type"] == s["type"])),
                lambda x: pair(s, x))))))))

    out = out.withColumn("met_alone", met("alone")).withColumn("met_united", met("united"))

    def verdict(places: str, slots_met: str) -> Column:
        exact = ~F.exists(slots_met, lambda s: ~s["b"].eqNullSafe(s["d"]))
        sources = F.array_distinct(F.transform(slots_met, lambda s: F.struct(s["type"], s["b"])))
        consistent = F.size(slots_met) == F.size(sources)
        return F.struct((exact | consistent).alias("good"), (F.size(places) / n).alias("coverage"), exact.alias("exact"),
                        consistent.alias("consistent"))

    best = F.greatest(verdict("alone", "met_alone"), verdict("united", "met_united"))
    return out.select("doc_id", "item_id", "form", "shift", n.alias("size"), best.alias("v")).select(
        "doc_id", "item_id", "form", "shift", "size", "v.coverage", "v.exact", "v.consistent")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``(doc_id, item_id, coverage, exact, n_alignments)``: the documents that hold an
    item, as it stands or re-parameterised: an alignment covers ``min_coverage`` of
    the item, and of a short one all but one token of a window, and is exact or
    consistent; part of the raw tokens counts unless the templates align as much with
    inconsistent slots. ``exact`` is that of the largest coverage, ``n_alignments`` the most
    of a form. Clean documents have no row."""
    least = F.greatest(F.least("size", F.lit(window)) - 1, F.lit(MIN_LITERALS))
    # stored: a filter pushed below would repeat the lists of an alignment for each of their elements
    far = materialize(alignments(docs, items, window), "aligned").filter((F.col("coverage") >= min_coverage)
                                                                          & (F.round(F.col("coverage") * F.col("size")) >= least))
    good = F.col("exact") | F.col("consistent")
    form = far.groupBy("doc_id", "item_id", "form").agg(
        F.max(F.when(good, F.struct("coverage", "exact"))).alias("best"), F.max(F.when(~good, F.col("coverage"))).alias("bad"),
        F.count(F.when(good, 1)).alias("n"))
    raw = F.col("form") == RAW
    both = form.groupBy("doc_id", "item_id").agg(
        F.max(F.when(~raw, F.col("best"))).alias("slots"), F.max(F.when(raw, F.col("best"))).alias("raw"),
        F.max("bad").alias("bad"), F.max("n").alias("n_alignments"))
    # part of an item's raw tokens does not outweigh inconsistent slots of as much of it
    whole = (F.col("raw.coverage") >= 1) | F.col("bad").isNull() | (F.col("bad") < F.col("raw.coverage"))
    best = F.greatest("slots", F.when(whole, F.col("raw")))
    return both.withColumn("best", best).filter("best is not null").select(
        "doc_id", "item_id", "best.coverage", "best.exact", "n_alignments")
