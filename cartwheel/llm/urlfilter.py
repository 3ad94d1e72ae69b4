"""URL filters with dated lists.

A list is a history of entries: from its date on, an ``add`` entry makes a domain or
an URL prefix listed, a ``remove`` entry ends that. Entries of one list and value become
validity intervals; every capture is judged by the entries active at its fetch
time, whatever the list says today.

The as-of join is an equi-join on (key, epoch). A capture yields a key for its host,
its parent domains and its path prefixes up to a fixed depth; a deeper entry is kept
under its key of that depth and compared in full. An interval is registered in every
epoch it overlaps, so a key with a long history meets a capture only with the
entries of the capture's own epoch. Only epochs in which something was captured count, so
one capture of a far date adds one epoch and not those in between; their list, which the
driver holds, has at most a number for every 64 days of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days per epoch of the as-of join.
EPOCH_DAYS = 64
#: Depth of lookup keys: last labels of a host, first segments of a path.
LABELS = 4
SEGMENTS = 3


def _clean_host(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(raw), r"\.+$", ""), r"^www\.", "")


def _clean_path(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^/+|/+$", "")


def host(url: Column) -> Column:
    """Lower-case host without user, port, trailing dots and a leading ``www.``."""
    return _clean_host(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """Path without query and fragment and without slashes at its ends."""
    return _clean_path(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1))


def _with_keys(rows: DataFrame) -> DataFrame:
    """One row per lookup key of ``rows(..., _host, _path)``."""
    rows = rows.withColumn("_l", F.split("_host", r"\.")).withColumn("_s", F.split("_path", "/"))
    domains = F.transform(
        F.sequence(F.lit(1), F.least(F.size("_l"), F.lit(LABELS))),
        lambda k: F.concat(F.lit("d:"), F.array_join(F.slice("_l", F.size("_l") - k + 1, k), ".")))
    prefixes = F.when(F.col("_path") == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.least(F.size("_s"), F.lit(SEGMENTS))),
        lambda k: F.concat(F.lit("u:"), "_host", F.lit("/"), F.array_join(F.slice("_s", F.lit(1), k), "/"))))
    return rows.withColumn("key", F.explode(F.concat(domains, prefixes))).drop("_l", "_s")


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, value, key, valid_from, valid_to)`` from dated ``entries(list, kind,
    value, day, action)``: half open, ``valid_to`` null while the entry still holds.

    ``kind`` domain: the value is a host and covers its subdomains; kind url: the
    value is host/path and covers that path and what lies below it. An entry
    holds until the next of its list and value; of several on one day the removal
    wins. Entries with a null field, an empty value, another kind or another action
    say nothing. The entries of a day are folded first, so repeated ones do not
    pile up in the history of a value.
    """
    known = entries.filter("list is not null and value is not null and day is not null "
                           "and action in ('add', 'remove') and kind in ('domain', 'url')")
    h = _clean_host(F.regexp_extract(F.trim("value"), r"^([^/?#:]*)", 1))
    p = _clean_path(F.regexp_extract(F.trim("value"), r"^[^/?#]*/([^?#]*)", 1))
    known = known.select("list", "kind", "day", "action", h.alias("_h"), F.when(F.col("kind") == "url", p).otherwise("").alias("_p"))
    known = known.filter("_h <> '' and (kind = 'domain' or _p <> '')")
    value = F.when(F.col("kind") == "domain", F.concat(F.lit("d:"), "_h")).otherwise(
        F.concat(F.lit("u:"), "_h", F.lit("/"), "_p"))
    short = F.when(F.col("kind") == "domain",
                   F.concat(F.lit("d:"), F.substring_index("_h", ".", -LABELS))).otherwise(
        F.concat(F.lit("u:"), "_h", F.lit("/"), F.substring_index("_p", "/", SEGMENTS)))
    days = (known.select("list", "day", "action", value.alias("value"), short.alias("key"))
            .groupBy("list", "value", "key", "day").agg(F.max("action").alias("action")))   # 'remove' > 'add'
    w = Window.partitionBy("list", "value", "key").orderBy("day")
    return (days.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add'")
            .select("list", "value", "key", F.col("day").alias("valid_from"), "valid_to"))


def _epoch(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(EPOCH_DAYS)).cast("int")


def judge(captures: DataFrame, entries: DataFrame, block: list[str], allow: list[str]) -> DataFrame:
    """``(capture_id, fetched, n_active, rule, blocked)`` for every row of
    ``captures(capture_id, url, fetched date)``.

    ``n_active``: entries (list and value) active for the URL at its fetch date;
    ``rule``: the first of them as ``list|value`` in code-point order, null without
    any; ``blocked``: an active entry of a ``block`` list and none of an ``allow``
    list. A capture with null or hostless URL or null date matches nothing and is
    not blocked. Repeated captures are judged once and returned as often as they
    occur. A hot host is split by AQE: captures only stream past its entries.
    """
    rows = captures.select("capture_id", "url", "fetched")
    asked_in = [r[0] for r in rows.filter("fetched is not null").select(_epoch(F.col("fetched"))).distinct().collect()]
    epochs = F.split(F.lit(",".join(map(str, asked_in)) or "0"), ",").cast("array<int>")
    last = _epoch(F.date_sub("valid_to", 1))
    spans = (intervals(entries)
             .withColumn("epoch", F.explode(F.filter(epochs, lambda e: (e >= _epoch(F.col("valid_from")))
                                                     & (F.col("valid_to").isNull() | (e <= last)))))
             .select("list", "value", "key", "epoch", "valid_from", "valid_to"))
    asked = (rows.filter("url is not null and fetched is not null").distinct()
             .withColumn("_host", host(F.col("url"))).withColumn("_path", path(F.col("url")))
             .filter("_host <> ''"))
    asked = _with_keys(asked).withColumn("epoch", _epoch(F.col("fetched")))
    covers = F.expr("""case when value like 'd:%'
                       then endswith(concat('.', _host), concat('.', substring(value, 3)))
                       else startswith(concat('u:', _host, '/', _path, '/'), concat(value, '/')) end""")
    hits = (asked.join(spans, ["key", "epoch"])
            .filter("valid_from <= fetched and (valid_to is null or fetched < valid_to)").filter(covers))
    on = ["capture_id", "url", "fetched"]
    verdict = hits.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_active"), F.min(F.concat_ws("|", "list", "value")).alias("rule"),
        F.max(F.col("list").isin(block).cast("int")).alias("_b"),
        F.max(F.col("list").isin(allow).cast("int")).alias("_a"))
    v = verdict.select(*[F.col(c).alias(f"_{c}") for c in on], "n_active", "rule", "_b", "_a")
    joined = rows.join(v, [rows[c].eqNullSafe(v[f"_{c}"]) for c in on], "left")
    return joined.select(
        "capture_id", "fetched", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), "rule",
        (F.coalesce("_b", F.lit(0)) > F.coalesce("_a", F.lit(0))).alias("blocked"))
