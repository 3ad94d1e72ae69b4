"""Invariants on the driver tables (sf0.001) and batch-vs-literal checks."""

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import basket, evaluate, features, postfilter, segments, similarity
from cartwheel.operators.skew import CELL, Grid, hot_keys, salted_join
from cartwheel.session import materialize
from cartwheel.sources.mart import load_mart
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def mart(spark):
    return load_mart(spark, SF_SMALL)


def test_shares_sum_to_one(mart):
    for col in ("prod_desc", "sub_category", "high_category"):
        s = features.category_share(mart.invoices, mart.products, col)
        sums = s.groupBy("customer_id").agg(F.sum("share").alias("t"))
        assert sums.filter(F.abs(F.col("t") - 1) > 1e-9).count() == 0


def test_confidence_in_unit_interval(mart):
    s = basket.basket_scores(mart.invoices)
    assert s.filter((F.col("score") <= 0) | (F.col("score") > 1)).count() == 0


def test_mba_batch_equals_literal_per_customer(mart, spark):
    """The all-customer rewrite equals the literal per-customer definition."""
    b = basket.baskets(mart.invoices).collect()
    by_c, buyers = {}, {}
    for r in b:
        by_c.setdefault(r.customer_id, set()).add((r.style_id, r.ref_id))
        buyers.setdefault((r.style_id, r.ref_id), set()).add(r.customer_id)
    got = {(r.customer_id, r.style_id, r.ref_id): r.score for r in basket.basket_scores(mart.invoices).collect()}
    for c in sorted(by_c)[:5]:
        sums = {}
        for i1 in by_c[c]:
            others = buyers[i1] - {c}
            counts = {}
            for o in others:
                for i2 in by_c[o]:
                    counts[i2] = counts.get(i2, 0) + 1
            for i2, n in counts.items():
                sums.setdefault(i2, []).append(n / len(buyers[i1]))
        expect = {i2: sum(v) / len(v) for i2, v in sums.items()}
        mine = {k[1:]: v for k, v in got.items() if k[0] == c}
        assert mine.keys() == expect.keys()
        assert all(abs(mine[k] - expect[k]) < 1e-12 for k in expect)


def test_cosine_symmetric_and_bounded(mart):
    c = similarity.customer_cosine(similarity.edges(mart))
    assert c.filter(F.col("cosine") > 1 + 1e-9).count() == 0
    rev = c.select(F.col("neighbour_id").alias("customer_id"), F.col("customer_id").alias("neighbour_id"),
                   F.col("cosine").alias("back"))
    j = c.join(rev, ["customer_id", "neighbour_id"])
    assert j.count() == c.count()
    assert j.filter(F.abs(F.col("cosine") - F.col("back")) > 1e-12).count() == 0


def test_zscores_have_mean_zero_and_unit_stddev(mart):
    names = features.DEFAULT_FEATURES
    z = features.zscore(features.feature_long(features.feature_arrays(mart, names), names))
    st = z.groupBy("feature", "slot").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()
    for r in st:
        assert abs(r.m) < 1e-9
        assert abs(r.s - 1) < 1e-9 or abs(r.s) < 1e-12


def test_no_owned_style_and_at_most_k_rows(mart):
    s = basket.basket_scores(mart.invoices)
    s = postfilter.top_k(postfilter.best_per_style(postfilter.exclude_recent(s, mart.invoices, -1)), 10)
    owned = mart.invoices.select("customer_id", "style_id").distinct()
    assert s.join(owned, ["customer_id", "style_id"]).count() == 0
    assert s.groupBy("customer_id").count().filter("count > 10").count() == 0


def test_salted_join_equals_plain_join(spark):
    """A key with a third of all rows is split into several salt groups and
    the join result is unchanged."""
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("v"))
    other = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("w"))
    hot = {r.k: r._salts for r in hot_keys(big, other, ["k"], 16).collect()}
    assert hot and hot[0] > 1
    salted = salted_join(big, other, ["k"], salt_by=["v"], partitions=16)
    plain = big.join(other, "k")
    assert sorted(map(tuple, salted.select("k", "v", "w").collect())) == \
        sorted(map(tuple, plain.select("k", "v", "w").collect()))
    left = salted_join(big, other.filter("k < 10"), ["k"], salt_by=["v"], how="left", partitions=16)
    assert left.count() == big.join(other.filter("k < 10"), "k", "left").count()


def test_few_and_many_cells_agree(mart):
    """The scores do not depend on the shape of the grid."""
    a = basket.basket_scores(mart.invoices)
    b = basket.basket_scores(mart.invoices, per_cell=20_000)
    ra = {(r.customer_id, r.style_id, r.ref_id): r.score for r in a.collect()}
    rb = {(r.customer_id, r.style_id, r.ref_id): r.score for r in b.collect()}
    assert ra.keys() == rb.keys()      # sums differ only in summation order
    assert all(abs(ra[k] - rb[k]) <= 1e-12 for k in ra)
    e = materialize(similarity.edges(mart))
    cos = similarity.customer_cosine(e)
    g1 = similarity.graph_recommendations(e, cos)
    g2 = similarity.graph_recommendations(e, cos, per_cell=20_000)
    g3 = similarity.graph_scores(e, per_cell=20_000)
    r1, r2, r3 = ({(r.customer_id, r.style_id): r.score for r in g.collect()} for g in (g1, g2, g3))
    assert r1.keys() == r2.keys() == r3.keys()
    assert all(abs(r1[k] - r2[k]) <= 1e-9 * max(1.0, abs(r1[k])) for k in r1)
    assert all(abs(r1[k] - r3[k]) <= 1e-9 * max(1.0, abs(r1[k])) for k in r1)


def test_universal_product_is_spread_over_cells(spark):
    """A product that everybody bought, and a customer who bought everything: the
    joined rows spread evenly over the cells, and salts follow the join's rows."""
    everybody = spark.range(400).select(F.col("id").alias("customer_id"), F.lit(0).cast("long").alias("i1"))
    everything = spark.range(400).select(F.lit(0).cast("long").alias("customer_id"), F.col("id").alias("i1"))
    left = everybody.union(everything).distinct()
    right = spark.range(400).select(F.lit(0).cast("long").alias("i1"), F.col("id").alias("sk2"))
    grid = Grid.sized(left, 800, 400, 160_000, per_cell=8_000)
    assert grid.rows * grid.cols >= 20
    j = grid.join(left, right, ["i1"], "customer_id", "sk2")
    cells = [r["count"] for r in j.groupBy(CELL).count().collect()]
    assert sum(cells) == 400 * 400 and len(cells) >= 20
    assert max(cells) < 3 * sum(cells) / len(cells)
    salts = hot_keys(left.withColumnRenamed("i1", "k"), left.withColumnRenamed("i1", "k"), ["k"], 16).collect()
    assert [(r.k, r._salts >= 15) for r in salts] == [(0, True)]


def test_basket_plan_moves_no_candidate(mart):
    """No exchange between the grid join and the per-customer ranking, no broadcast hint."""
    plan = basket.basket_top_k(mart.invoices, 10)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    first = next(i for i, x in enumerate(lines) if "hashpartitioning(customer_id" in x)
    grid_join = next(i for i, x in enumerate(lines) if "ShuffledHashJoin" in x and "i1#" in x)
    between = [x for x in lines[first + 1:grid_join] if "Exchange" in x and "passthrough" not in x]
    assert not between


def test_batch_equals_cohort(mart, spark):
    """Each technique answers a cohort as it answers everybody."""
    cohort = spark.createDataFrame([(3,), (7,), (12,)], "customer_id long")
    e = materialize(similarity.edges(mart))
    vec = materialize(features.feature_vectors(mart))
    centres = vec.filter("customer_id % 20 = 1").select(F.col("customer_id").cast("int").alias("segment"),
                                                       F.col("values").alias("centre"))
    a = segments.segment_model(vec, centres)[2]
    inv = mart.invoices

    def rel(cohort=None):
        s = inv.select("customer_id", "style_id").distinct().withColumn("customer_id", F.col("customer_id") + 1)
        return evaluate.relevance_by_customer(s.withColumn("score", F.lit(1.0)), inv, mart.products, cohort=cohort)

    for every, some in (
            (basket.basket_top_k(inv, 5, score_digits=9), basket.basket_top_k(inv, 5, cohort, score_digits=9)),
            (similarity.graph_scores(e), similarity.graph_scores(e, cohort=cohort)),
            (segments.segment_recommendations(inv, a), segments.segment_recommendations(inv, a, cohort)),
            (segments.segment_top_k(inv, a, 5), segments.segment_top_k(inv, a, 5, cohort=cohort)),
            (features.feature_vectors(mart).drop("features"), features.feature_vectors(mart, cohort=cohort).drop("features")),
            (rel(), rel(cohort))):
        def key(df):
            return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v)[:60] for v in r) for r in df.collect())
        expect = key(every.join(cohort, "customer_id", "left_semi"))
        assert expect and key(some) == expect


def test_segment_top_k_equals_filtered_full_scores(mart):
    """The ranking per segment gives what filtering and ranking all scores gives."""
    vec = materialize(features.feature_vectors(mart))
    centres = vec.filter("customer_id % 20 = 1").select(F.col("customer_id").cast("int").alias("segment"),
                                                       F.col("values").alias("centre"))
    a = segments.segment_model(vec, centres)[2]
    full = segments.segment_recommendations(mart.invoices, a)
    for args in ((-1,), (24, "2001-08-01"), (24, "2001-08-01", True)):
        expect = postfilter.exclude_recent(full, mart.invoices, *args)
        expect = postfilter.top_k(postfilter.exclude_tags(expect, mart.mixes, ["MIX_2"]), 7)
        got = segments.segment_top_k(mart.invoices, a, 7, *args,
                                     keep=lambda s: postfilter.exclude_tags(s, mart.mixes, ["MIX_2"]))
        key = lambda df: sorted((r.customer_id, r.rank, r.style_id, round(r.score, 2)) for r in df.collect())
        assert key(expect) and key(got) == key(expect)


def test_top_k_plan_equals_filtered_full_scores(mart):
    full = basket.basket_scores(mart.invoices).withColumn("score", F.round("score", 9))
    full = postfilter.top_k(postfilter.best_per_style(postfilter.exclude_recent(full, mart.invoices, -1)), 10)
    fast = basket.basket_top_k(mart.invoices, 10, score_digits=9)
    key = lambda df: sorted((r.customer_id, r.rank, r.style_id, r.score) for r in df.collect())
    assert key(full.select("customer_id", "rank", "style_id", "score")) == key(fast)
