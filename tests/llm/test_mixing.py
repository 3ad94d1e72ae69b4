"""The systematic draw of the mix: near the targets, with unchanged probabilities."""

import collections
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cartwheel.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def test_query_meets_its_targets(spark):
    """Every source within 5 % of its target, or within its largest document; 3 times a size at most."""
    df = entry.queries()["op5_mix_sources"](spark, "/root/testdata/sf0.01")
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double",
                               "taken": "bigint"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = df.join(docs, "doc_id").collect()
    taken, largest, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        target[r.source] = r.target
    assert len(rows) == docs.count()
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.05 * t, largest[s]), s


def test_places_are_the_plain_order_and_chances_the_fractions(spark):
    """Places equal a plain sort; over many starts a document is taken once more as often as
    its source's fraction says."""
    data = [(i, "w " * (1 + (i * 37) % 90), "s") for i in range(300)] + [(None, "w w", "s"), (None, "w w", "s"), (5, "w w w", None)]
    sized = mixing.sizes(spark.createDataFrame(data, SCHEMA))
    units = sized.groupBy("source", "doc_id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("words"))
    got = mixing.placed(units).select("source", "doc_id", "size", "words", "place", mixing.size_class(F.col("words"), 6).alias("c"),
                                      mixing.coin(F.col("doc_id")).alias("coin")).collect()
    assert len(got) == 302
    for source in ("s", None):
        rows = [r for r in got if r.source == source]
        plain = sorted(rows, key=lambda r: (-r.c, r.coin, r.doc_id is None, r.doc_id or 0, r["size"]))
        assert [r.place for r in plain] == list(range(1, len(rows) + 1))
    starts = spark.range(1000).select((F.col("id") / 1000).alias("start"))
    for rate in (0.3, 1.75, 2.0, 0.0):
        n = starts.select(*[mixing.copies(F.lit(rate), F.lit(p), F.col("start")).alias(f"p{p}") for p in (1, 2, 77)])
        for p in (1, 2, 77):
            seen = [r[0] for r in n.select(f"p{p}").collect()]
            assert set(seen) <= {math.floor(rate), math.floor(rate) + 1}
            assert sum(seen) / 1000 == pytest.approx(rate, abs=0.002)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b", "s")] * 4 + [(None, "c d e", "s")] * 3 + [(2, None, None), (3, "", "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in ("row", "size", "copies", "key", "place", "a.b", "unit_id")])
    decided = mixing.decide(odd).collect()
    assert len(decided) == len(rows)
    assert len({r.copies for r in decided if r.doc_id == 1}) == 1 and len({r.copies for r in decided if r.doc_id is None}) == 1
    out = mixing.emit(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in decided)
    assert {r["size"] for r in out.collect()} == {"mine size"}
    assert sorted(map(tuple, mixing.decide(odd).collect()), key=repr) == sorted(map(tuple, decided), key=repr)
