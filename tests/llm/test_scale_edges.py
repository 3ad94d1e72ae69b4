"""Rows that once blew up or got lost: far dates in the URL filters, texts behind the shards."""

import datetime as dt
import zlib
from collections import Counter

from cartwheel.llm import sharding, urlfilter

CAPTURES = "capture_id long, url string, fetched date"
ENTRIES = "list string, kind string, value string, day date, action string"


def day(s):
    return dt.date.fromisoformat(s)


def test_far_dates_judge_like_any_other(spark):
    """Captures of the first and last day there is: each is judged by the entries active then, and an
    entry is met in the epochs of captures only."""
    captures = spark.createDataFrame([
        (1, "http://a.com/x", day("0001-01-01")), (2, "http://a.com/x", day("2020-05-01")), (3, "http://a.com/x", day("9999-12-31")),
        (4, "http://b.com/", day("2020-05-01")), (5, "http://b.com/", day("9999-12-31")), (6, None, day("2020-05-01")),
        (7, "http://a.com/x", None)], CAPTURES)
    entries = spark.createDataFrame([
        ("ads", "domain", "a.com", day("2020-01-01"), "add"), ("ads", "domain", "b.com", day("2020-01-01"), "add"),
        ("ads", "domain", "b.com", day("2021-01-01"), "remove"), ("ads", "domain", "a.com", day("0001-01-02"), "remove")], ENTRIES)
    out = urlfilter.judge(captures, entries, ["ads"], [])
    assert {r.capture_id: (r.n_active, r.blocked) for r in out.collect()} == {
        1: (0, False), 2: (1, True), 3: (1, True), 4: (1, True), 5: (0, False), 6: (0, False), 7: (0, False)}
    undated = captures.filter("fetched is null")
    assert [(r.n_active, r.blocked) for r in urlfilter.judge(undated, entries, ["ads"], []).collect()] == [(0, False)]


def test_judge_equals_brute_force_over_many_days(spark):
    """Every capture against every entry's history, days around interval ends and epoch borders."""
    base = day("2019-12-01")
    days = [base + dt.timedelta(days=d) for d in (0, 1, 31, 62, 63, 64, 65, 127, 128, 400)]
    captures = [(i, f"http://h{i % 3}.org/p", d) for i, d in enumerate(days * 3)]
    history = [("l", "domain", f"h{h}.org", base + dt.timedelta(days=5 * h + 31 * k), "add" if k % 2 == 0 else "remove")
               for h in range(3) for k in range(h + 3)]
    got = urlfilter.judge(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(history, ENTRIES), ["l"], [])
    want = {}
    for i, url, d in captures:
        past = sorted((e[3], e[4]) for e in history if url.startswith(f"http://{e[2]}/") and e[3] <= d)
        want[i] = bool(past) and past[-1][1] == "add"
    assert {r.capture_id: r.blocked for r in got.collect()} == want


def test_shards_keep_rows_and_texts(spark):
    """Every row comes out once with its own columns, ids repeated and null, names that clash."""
    rows = [(1, "a b", "s", 7), (1, "a b", "s", 8), (1, "c", "s", 9), (None, None, "t", 1), (None, "é" * 300, None, 2), (3, "", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, `a.b` int")
    out = sharding.shard_rows(docs, shards=3)
    assert out.columns == ["doc_id", "text", "shard", "a.b", "size", "text_crc32", "_shard", "slot"]
    got = out.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    for r in got:
        raw = None if r.text is None else r.text.encode()
        assert r["size"] == len(raw or b"") + 16 and r.text_crc32 == (None if raw is None else zlib.crc32(raw))
    assert len({r["_shard"] for r in got if r.text == "a b"}) == 1
    for s in {r["_shard"] for r in got}:
        slots = sorted(r.slot for r in got if r["_shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_rows(docs.limit(0)).count() == 0
