"""Hand-checked values on the 9-line fixture (FIXTURES.md section 3)."""

from pyspark.sql import functions as F

from cartwheel import functions as fn
from cartwheel.operators import basket, evaluate, features, postfilter, segments, similarity
from conftest import rows


def test_mba_scores_per_product(golden):
    s = basket.basket_scores(golden.invoices)
    got = {(r.customer_id, r.style_id, r.ref_id): round(r.score, 6) for r in s.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {
        ("A", 0): 0.583333, ("B", 0): 0.416667, ("C", 0): 0.333333, ("C", 1): 0.416667}
    assert {k[1:]: v for k, v in got.items() if k[0] == 2} == {
        ("A", 0): 0.666667, ("B", 0): 0.666667, ("C", 1): 0.333333}
    assert {k[1:]: v for k, v in got.items() if k[0] == 3} == {
        ("A", 0): 0.583333, ("B", 0): 0.416667, ("C", 0): 0.333333}
    assert not [k for k in got if k[0] == 4]


def test_mba_owned_dropped_and_max_per_style(golden):
    s = basket.basket_scores(golden.invoices)
    s = postfilter.best_per_style(postfilter.exclude_recent(s, golden.invoices, months=-1))
    assert rows(s.filter("customer_id = 1"), "style_id", "score") == [("C", 0.416667)]


def test_cosine_aggregated_and_per_line(golden):
    e = similarity.edges(golden)
    agg = similarity.customer_cosine(e).filter("customer_id = 1")
    assert rows(agg, "neighbour_id", "cosine") == [(1, 1.0), (2, 0.631474), (3, 0.783015)]
    line = similarity.customer_cosine(e, per_line_norm=True).filter("customer_id = 1")
    assert rows(line, "neighbour_id", "cosine") == [(1, 1.761905), (2, 0.838198), (3, 1.039349)]


def test_graph_recommendation_sum(golden):
    e = similarity.edges(golden)
    recs = similarity.graph_recommendations(e, similarity.customer_cosine(e))
    recs = postfilter.exclude_recent(recs, golden.invoices, months=-1).filter("customer_id = 1")
    assert rows(recs, "style_id", "score") == [("C", 10.70975)]


def test_segment_peers_spend(golden, spark):
    assignment = spark.createDataFrame([(c, 7, 7) for c in (1, 2, 3)], "customer_id long, nearest int, segment int")
    recs = segments.segment_recommendations(golden.invoices, assignment).filter("customer_id = 1")
    assert rows(recs, "style_id", "score") == [("A", 20.0), ("B", 10.0), ("C", 16.0)]


def test_spend_stats(golden):
    s = features.spend_stats(golden.invoices)
    assert rows(s, "customer_id", "avg_spend", "total_spend") == [
        (1, 11.666667, 35.0), (2, 11.0, 22.0), (3, 8.0, 24.0), (4, 7.0, 7.0)]
    st = s.agg(F.avg("avg_spend").alias("m"), F.stddev_pop("avg_spend").alias("s")).first()
    assert (round(st.m, 6), round(st.s, 6)) == (9.416667, 1.963203)


def test_recency_rules(golden):
    sugg = golden.invoices.select("customer_id", "style_id").distinct().withColumn("score", F.lit(1.0))
    doc = postfilter.exclude_recent(sugg, golden.invoices, 3, "2016-07-01")
    ref = postfilter.exclude_recent(sugg, golden.invoices, 3, "2016-07-01", any_old_purchase=True)
    assert rows(doc.filter("customer_id = 1"), "style_id") == [("B",)]
    assert rows(ref.filter("customer_id = 1"), "style_id") == [("A",), ("B",)]
    # bought exactly on the cutoff day: blocked under both rules
    for df in (doc, ref):
        assert ("A",) not in rows(df.filter("customer_id = 3"), "style_id")


def test_tag_exclusion(golden, spark):
    sugg = spark.createDataFrame([(1, s, 1.0) for s in "ABCD"], "customer_id long, style_id string, score double")
    kept = postfilter.exclude_tags(sugg, golden.mixes, ["m2"])
    assert rows(kept, "style_id") == [("A",), ("C",), ("D",)]
    tagged = postfilter.exclude_tags(sugg, golden.mixes, ["m2"], require_tag=True)
    assert rows(tagged, "style_id") == [("A",), ("C",)]


def test_relevance_of_two_suggestions(golden, spark):
    sugg = spark.createDataFrame([(1, "C", 2.0), (1, "D", 1.0)], "customer_id long, style_id string, score double")
    v = evaluate.relevance_by_customer(sugg, golden.invoices, golden.products)
    assert rows(v, "customer_id", "n_suggestions", "relevance") == [(1, 2, 37.5)]


def test_shares(golden):
    high = features.category_share(golden.invoices, golden.products, "high_category").filter("customer_id = 1")
    assert rows(high, "value", "share") == [("HDS", 1.0)]          # CPT absent = 0 in the vector
    tags = features.tag_share(golden.invoices, golden.mixes).filter("customer_id = 1")
    assert rows(tags, "value", "share") == [("m1", 0.75), ("m2", 0.25)]


def test_scalar_parsers(spark):
    df = spark.createDataFrame([("1,234", "2015-03-01", "7/4/1999"), ("x", "2015-03-01", "#N/A")],
                               "a string, b string, c string")
    got = df.select(fn.comma_number("a"), fn.iso_year("b"), fn.slash_year("c")).collect()
    assert [tuple(r) for r in got] == [(1234.0, 2015.0, 1999.0), (None, 2015.0, 1946.0)]


def test_zscore_of_constant_column_is_centred(spark):
    long = spark.createDataFrame([(c, "f", 0, 5.0) for c in range(4)],
                                 "customer_id long, feature string, slot int, value double")
    assert {r.z for r in features.zscore(long).collect()} == {0.0}


def test_text_formats(spark):
    df = spark.createDataFrame([(1234.5, 0.123456789, 37.5)], "m double, s double, p double")
    r = df.select(fn.money("m"), fn.score_text("s"), fn.percent_text("p")).first()
    assert tuple(r) == ("$1234.50", "0.1235", "37.5%")


def test_cohort_restricts_targets_only(golden, spark):
    cohort = spark.createDataFrame([(1,)], "customer_id long")
    one = basket.basket_scores(golden.invoices, cohort=cohort)
    assert {r.customer_id for r in one.collect()} == {1}
    assert rows(one, "style_id", "ref_id", "score") == [
        ("A", 0, 0.583333), ("B", 0, 0.416667), ("C", 0, 0.333333), ("C", 1, 0.416667)]
    e = similarity.edges(golden)
    cos = similarity.customer_cosine(e, cohort=cohort)
    assert rows(cos, "customer_id", "neighbour_id", "cosine") == [(1, 1, 1.0), (1, 2, 0.631474), (1, 3, 0.783015)]


def test_graph_best_single_line(golden):
    e = similarity.edges(golden)
    recs = similarity.graph_recommendations(e, similarity.customer_cosine(e), agg="max")
    # neighbour 2 bought C for 12, neighbour 3 for 4: the best line is 12 x 0.631474
    assert rows(recs.filter("customer_id = 1 AND style_id = 'C'"), "score") == [(7.577688,)]


def test_report_ranks_live_styles_only(spark, golden):
    from cartwheel.operators import report
    recs = spark.createDataFrame([(1, "Z", 9.0), (1, "A", 5.0), (1, "A", 4.0), (1, "B", 3.0), (1, "C", 1.0)],
                                 "customer_id long, style_id string, score double")
    r = report.suggestion_report(recs, golden.products, golden.mixes, golden.customers, k=2)
    assert rows(r, "rank", "style_id", "customer_name", "score") == [(1, "A", "Customer 1", 5.0), (2, "B", "Customer 1", 3.0)]


def test_left_features_keep_every_customer(golden):
    from cartwheel.operators import features
    names = ["SUB_CATEGORY", "TotalExpenditure"] if "SUB_CATEGORY" in features.FEATURE_CATALOG else ["TotalExpenditure"]
    inner = features.feature_arrays(golden, names)
    left = features.feature_arrays(golden, names, how="left")
    assert left.count() == golden.customers.count() > inner.count()


def test_graph_scores_equal_customer_pairs(golden):
    e = similarity.edges(golden)
    for per_line in (False, True):
        pairs = similarity.graph_recommendations(e, similarity.customer_cosine(e, per_line_norm=per_line))
        direct = similarity.graph_scores(e, per_line_norm=per_line)
        assert rows(direct, "customer_id", "style_id", "score") == rows(pairs, "customer_id", "style_id", "score")
