"""Model fits, save/load round trips, CSV sources and the table sink."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cartwheel import functions as fn
from cartwheel.operators import factors, features, segments, tune
from cartwheel.session import scratch_path
from cartwheel.sources import files, sinks, warehouse
from cartwheel.sources.mart import load_mart
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def mart(spark):
    return load_mart(spark, SF_SMALL)


def test_als_is_repeatable_and_beats_mean_rating(mart, spark):
    r = factors.ratings(mart.invoices)
    a = factors.fit_als(r, rank=8, max_iter=5, reg=0.1, seed=7, blocks=2)
    b = factors.fit_als(r, rank=8, max_iter=5, reg=0.1, seed=7, blocks=2)
    ra = factors.recommend(a, mart.invoices, 5).select("customer_id", "style_id", F.round("score", 3))
    rb = factors.recommend(b, mart.invoices, 5).select("customer_id", "style_id", F.round("score", 3))
    assert sorted(map(tuple, ra.collect())) == sorted(map(tuple, rb.collect()))
    mean = r.agg(F.avg("rating")).first()[0]
    base = r.agg(F.sqrt(F.avg((F.col("rating") - mean) ** 2))).first()[0]
    assert factors.training_rmse(a, r) < base
    # top-k excludes owned styles and keeps k rows for every customer
    owned = mart.invoices.select("customer_id", "style_id").distinct()
    assert ra.join(owned, ["customer_id", "style_id"]).count() == 0
    assert ra.groupBy("customer_id").count().filter("count <> 5").count() == 0


def test_als_save_load_round_trip(mart, spark):
    r = factors.ratings(mart.invoices)
    m = factors.fit_als(r, rank=4, max_iter=3, reg=0.1, seed=1)
    path = scratch_path(spark, "als-test")
    factors.save_model(m, path)
    p1 = factors.predict(m, r).select("customer_id", "style_id", "score")
    p2 = factors.predict(factors.load_model(path), r).select("customer_id", "style_id", "score")
    assert sorted(map(tuple, p1.collect())) == sorted(map(tuple, p2.collect()))


def test_kmeans_save_load_keeps_features(mart, spark):
    names = ["StyleYear", "AverageExpenditure"]
    vec = features.feature_vectors(mart, names)
    model = segments.train_kmeans(vec, k=3, max_iter=3, seed=3)
    path = scratch_path(spark, "kmeans-test")
    segments.save_model(model, names, path)
    loaded, got = segments.load_model(spark, path)
    assert got == names
    a = model.transform(vec).select("customer_id", "prediction").collect()
    b = loaded.transform(vec).select("customer_id", "prediction").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_fallback_walks_to_populated_segment(spark):
    vec = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 0.1, 0.2, 0.3, 0.4, 0.5, 9.0])],
                                "customer_id long, values array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "segment int, centre array<double>")
    near, pops_df, assigned = segments.segment_model(vec, centres)
    pops = {r.segment: r.population for r in pops_df.collect()}
    assert pops == {0: 6, 1: 1}
    a = {r.customer_id: (r.nearest, r.segment, r.fallback_rank) for r in assigned.collect()}
    assert a[6] == (1, 0, 1) and a[0] == (0, 0, 0)
    # blocks of one centre and slices of one customer give the same answer
    old = segments.CENTRES_PER_BLOCK, segments.DISTANCES_AT_A_TIME
    segments.CENTRES_PER_BLOCK = segments.DISTANCES_AT_A_TIME = 1
    try:
        b = {r.customer_id: (r.nearest, r.segment, r.fallback_rank)
             for r in segments.assign_segments(vec, centres, pops_df).collect()}
    finally:
        segments.CENTRES_PER_BLOCK, segments.DISTANCES_AT_A_TIME = old
    assert b == a


def test_csv_round_trip(mart, spark):
    base = tempfile.mkdtemp(prefix="cartwheel-csv-")
    files.write_file_mart(mart, base)
    back = files.read_file_mart(spark, base)
    assert back.invoices.count() == mart.invoices.count()
    assert back.customers.count() == mart.customers.count()
    assert back.products.count() == mart.products.count()
    assert back.mixes.count() == mart.mixes.count()
    s1 = mart.invoices.agg(F.sum("spend")).first()[0]
    s2 = back.invoices.agg(F.sum("spend")).first()[0]
    assert s1 == s2


def test_sink_appends_with_declared_shape(spark):
    shape = "customer_id long, style_id string, score double"
    df = spark.createDataFrame([(3_000_000_000, "A", 2.0), (2, "B", 1.0)], shape)
    assert sinks.qualified_table_name("recs_test") == "default.recs_test"
    assert sinks.qualified_table_name("db.t") == "db.t"
    name = sinks.append_recommendations(df, "recs_test")
    sinks.append_recommendations(df, "recs_test")
    t = spark.table(name)
    assert t.count() == 4
    assert [(f.name, f.dataType.simpleString()) for f in t.schema.fields] == [
        ("CustomerID", "bigint"), ("SellingStyleNo", "string"), ("Score", "double")]


def test_sink_refuses_nulls_and_declares_none(spark):
    shape = "customer_id long, style_id string, score double"
    assert not any(f.nullable for f in sinks.recommendation_rows(spark.createDataFrame([], shape)).schema.fields)
    for bad in ((3, None, 1.0), (None, "A", 1.0), (3, "A", None)):
        with pytest.raises(Exception, match="in recommendations"):
            sinks.recommendation_rows(spark.createDataFrame([(1, "A", 1.0), bad], shape)).collect()


def test_warehouse_shapes(spark):
    c = warehouse.warehouse_customers(spark, SF_SMALL)
    assert c.filter(~F.col("status").isin("A", "Z")).count() == 0
    m = warehouse.margin_lines(spark, SF_SMALL)
    assert m.filter(F.col("margin_pct").isNull()).count() == 0
    assert warehouse.product_star(spark, SF_SMALL).count() > 0


def test_best_model_of_each_parameter_set(spark):
    rows = [('{"k": 3, "model": 0}', 5, 40.0), ('{"k": 3, "model": 1}', 5, 60.0), ('{"k": 3, "model": 2}', 5, 60.0),
            ('{"k": 4, "model": 0}', 5, 10.0)]
    got = tune.best_runs(spark.createDataFrame(rows, "params string, customers long, relevance double"))
    assert sorted(map(tuple, got.collect())) == [('{"k":"3"}', 1, 5, 60.0), ('{"k":"4"}', 0, 5, 10.0)]


def test_als_long_lists_are_asked_in_groups(mart, spark):
    """A buyer of almost every style leaves the others' lists whole and gets the rest."""
    styles = [r.style_id for r in mart.invoices.select("style_id").distinct().collect()]
    most = spark.createDataFrame([(10_000, s, 5.0) for s in styles[3:]], "customer_id long, style_id string, rating double")
    r = factors.ratings(mart.invoices).unionByName(most)
    recs = factors.recommend(factors.fit_als(r, rank=4, max_iter=2, reg=0.1, seed=1), r, 5)
    n = {x.customer_id: x["count"] for x in recs.groupBy("customer_id").count().collect()}
    assert n.pop(10_000) == 3 and set(n.values()) == {5}
    assert recs.join(r, ["customer_id", "style_id"]).count() == 0


def test_export_twice_leaves_one_copy(spark):
    shape = "customer_id long, style_id string, score double"
    one = spark.createDataFrame([(1, "A", 2.0), (2, "B", 1.0)], shape)
    two = spark.createDataFrame([(9, "C", 5.0)], shape)
    for rows, run in ((one, "monday"), (two, "tuesday"), (one, "monday")):
        sinks.replace_recommendations(rows, "runs_test", run)
    assert sorted(map(tuple, sinks.exported(spark, "runs_test", "monday").collect())) == [(1, "A", 2.0), (2, "B", 1.0)]
    assert spark.table("default.runs_test").count() == 3
    sinks.replace_recommendations(two, "runs_test", "monday")                 # a corrected run
    assert [tuple(r) for r in sinks.exported(spark, "runs_test", "monday").collect()] == [(9, "C", 5.0)]
    sinks.replace_recommendations(one.limit(0), "runs_test", "monday")        # a run without suggestions
    assert sinks.exported(spark, "runs_test", "monday").count() == 0
    assert sinks.exported(spark, "runs_test", "tuesday").count() == 1


def test_array_and_key_functions(spark):
    row = spark.createDataFrame([([1.0, 4.0], [3.0, 2.0], "S1", 7, 3, 2.5)], "a array<double>, b array<double>, s string, r int, q int, p double")
    got = row.select(fn.array_add("a", "b"), fn.array_scale("a", 2), fn.item_key_style(fn.item_key("s", "r")), fn.line_amount("q", "p"),
                     fn.score_text("p"), fn.percent_text("p")).first()
    assert tuple(got) == ([4.0, 6.0], [0.5, 2.0], "S1", 7.5, "2.5000", "2.5%")
