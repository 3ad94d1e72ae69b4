"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query loads the mart from the driver tables in ``sf_dir`` and runs one
library operator over whole tables. Output columns are aliased and rounded the
same way as the DuckDB statements in ``plans.oracle`` (ratios to 9 digits,
money-scaled scores to 4), so results can be compared value by value.
"""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import functions as fn
from ..operators import als, basket, evaluate, factors, features, kmeans, neighbours, postfilter, report, segments, similarity, tune
from ..session import checkpoint_dir, materialize, scratch_path
from ..sources import files, sinks, warehouse
from ..sources.mart import CUSTOMER, ITEM, REF, STYLE, load_mart, load_raw_mart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
AS_OF = "2001-08-01"
RECENCY_MONTHS = 24
EXCLUDED_TAGS = ["MIX_2", "MIX_7"]
TOP_K = 10
REPORT_K = 20
COHORT = 100


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def r9(c):
    return F.round(c, 9)


# --- market basket (A1-A4, R1, P6, A17, T2) --------------------------------

@query("basket_support")
def basket_support(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return basket.item_support(basket.baskets(m.invoices)).select(
        STYLE, REF, F.col("support").cast("bigint"))


@query("basket_pairs")
def basket_pairs(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return basket.pair_counts(basket.baskets(m.invoices)).select(
        "style_1", "ref_1", "style_2", "ref_2", F.col("co_count").cast("bigint"),
        F.col("support").cast("bigint"))


def _mba_scores(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    s = basket.basket_scores(m.invoices)
    return m, s.select(CUSTOMER, STYLE, REF, r9(F.col("score")).alias("score"))


@query("mba_scores")
def mba_scores(spark, sf_dir):
    return _mba_scores(spark, sf_dir)[1]


def mba_top(spark, sf_dir, k=TOP_K):
    m = load_mart(spark, sf_dir)
    top = basket.basket_top_k(m.invoices, k, score_digits=9)
    return top.select(CUSTOMER, F.col("rank").cast("int"), STYLE, "score")


@query("mba_top10")
def mba_top10(spark, sf_dir):
    return mba_top(spark, sf_dir)


@query("best_customers_mba")
def best_customers_mba(spark, sf_dir):
    """The flagship query for a cohort, the ``COHORT`` customers of highest spend."""
    m = load_mart(spark, sf_dir)
    cohort = features.spend_stats(m.invoices).orderBy(F.col("total_spend").desc(), CUSTOMER).limit(COHORT).select(CUSTOMER)
    top = basket.basket_top_k(m.invoices, TOP_K, cohort=materialize(cohort, "cohort"), score_digits=9)
    return top.select(CUSTOMER, F.col("rank").cast("int"), STYLE, "score")


def r4(c):
    return F.round(c, 4)


def rebuy_suggestions(invoices: DataFrame) -> DataFrame:
    """Suggestion-shaped input for the filter queries: every style a customer
    bought, scored by its spend."""
    return invoices.groupBy(CUSTOMER, STYLE).agg(F.sum("spend").cast("double").alias("score"))


# --- sources (S2-S8, F1-F6) ------------------------------------------------

@query("invoice_lines")
def invoice_lines(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return m.invoices.select(CUSTOMER, STYLE, REF, "invoice_date", "quantity", "unit_price",
                             F.col("spend").cast("double").alias("spend"))


@query("active_customers")
def active_customers(spark, sf_dir):
    return load_mart(spark, sf_dir).customers


@query("live_products")
def live_products_q(spark, sf_dir):
    return load_mart(spark, sf_dir).products


@query("margin_lines")
def margin_lines_q(spark, sf_dir):
    df = warehouse.margin_lines(spark, sf_dir)
    return df.select(CUSTOMER, STYLE, REF, "invoice_date", "invoice_month", "division_id", "company_id",
                     "quantity", "unit_price", F.col("spend").cast("double").alias("spend"),
                     r9(F.col("margin_pct")).alias("margin_pct"))


@query("warehouse_customers")
def warehouse_customers_q(spark, sf_dir):
    return warehouse.warehouse_customers(spark, sf_dir)


@query("product_star_join")
def product_star_join(spark, sf_dir):
    return warehouse.product_star(spark, sf_dir)


@query("parse_amounts_and_years")
def parse_amounts_and_years(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    c = m.customers.select(CUSTOMER, fn.comma_number("zip").alias("zip_number"),
                           fn.slash_year("active_date").alias("active_year"),
                           fn.str_or_empty("credit_type").alias("credit_text"))
    years = (m.invoices.select(CUSTOMER, *ITEM).join(m.products.select(*ITEM, "intro_date"), ITEM)
             .groupBy(CUSTOMER).agg(F.max(fn.iso_year("intro_date")).alias("latest_style_year")))
    return c.join(years, CUSTOMER, "left")


# --- tags and post-filters (A5, P5, P6) -------------------------------------

@query("product_tags")
def product_tags(spark, sf_dir):
    t = report.style_tags(load_mart(spark, sf_dir).mixes)
    return t.select(STYLE, "tags", F.col("n_tags").cast("bigint"))


@query("tag_exclusion")
def tag_exclusion(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return postfilter.exclude_tags(rebuy_suggestions(m.invoices), m.mixes, EXCLUDED_TAGS)


@query("recency_exclusion")
def recency_exclusion(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return postfilter.exclude_recent(rebuy_suggestions(m.invoices), m.invoices, RECENCY_MONTHS, AS_OF)


@query("recency_any_old")
def recency_any_old(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return postfilter.exclude_recent(rebuy_suggestions(m.invoices), m.invoices, RECENCY_MONTHS, AS_OF,
                                     any_old_purchase=True)


# --- history and spend (A8-A10, A14) -----------------------------------------

@query("customer_top_purchases")
def customer_top_purchases(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    t = report.top_purchases(m.invoices, m.products, m.mixes, k=REPORT_K)
    return t.withColumn("rank", F.col("rank").cast("int"))


@query("customer_spend_stats")
def customer_spend_stats(spark, sf_dir):
    s = features.spend_stats(load_mart(spark, sf_dir).invoices)
    return s.select(CUSTOMER, "total_spend", F.col("lines").cast("bigint"),
                    r9(F.col("avg_spend")).alias("avg_spend"))


@query("avg_style_year")
def avg_style_year(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    s = features.style_stats(m.invoices, m.products)
    return s.select(CUSTOMER, r9(F.col("avg_pile_weight")).alias("avg_pile_weight"),
                    r9(F.col("total_pile_weight")).alias("total_pile_weight"),
                    r9(F.col("avg_style_year")).alias("avg_style_year"))


# --- categories and features (A6, A7, A11, A19, E2-E6) -----------------------

@query("category_dictionary")
def category_dictionary(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    parts = [features.category_dictionary(m.products, col).select(F.lit(name).alias("dimension"), "value", "slot")
             for name, col in features.PRODUCT_CATEGORY.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _share_query(column):
    def run(spark, sf_dir):
        m = load_mart(spark, sf_dir)
        s = features.category_share(m.invoices, m.products, column)
        return s.select(CUSTOMER, "value", r9(F.col("share")).alias("share"))
    return run


QUERIES["category_share_desc"] = _share_query("prod_desc")
QUERIES["category_share_sub"] = _share_query("sub_category")
QUERIES["category_share_high"] = _share_query("high_category")


@query("tag_share")
def tag_share(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return features.tag_share(m.invoices, m.mixes).select(CUSTOMER, "value", r9(F.col("share")).alias("share"))


@query("customer_one_hot")
def customer_one_hot(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    parts = [features.one_hot(m.customers, col).select(CUSTOMER, F.lit(name).alias("feature"), "value", "slot")
             for name, col in features.CUSTOMER_CATEGORY.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("household_features")
def household_features(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return features.customer_households(m.customers, m.households)


@query("feature_zscore")
def feature_zscore(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    names = features.FEATURE_CATALOG
    z = features.zscore(features.feature_long(features.feature_arrays(m, names), names))
    # z-scores amplify float noise of mean and stddev: 6 digits are engine-stable
    return z.select(CUSTOMER, "feature", "slot", F.round(F.col("z"), 6).alias("z"))


def r2(c):
    return F.round(c, 2)


# --- purchase graph (U1, R10-R12) -------------------------------------------

@query("purchase_graph")
def purchase_graph(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    e = similarity.edges(m)
    c = e.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight")).select(
        F.concat(F.lit("c:"), F.col(CUSTOMER).cast("string")).alias("id"), "degree", "weight")
    p = e.groupBy(STYLE, REF).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight")).select(
        F.concat(F.lit("p:"), fn.item_key(STYLE, REF)).alias("id"), "degree", "weight")
    return (similarity.vertices(m).join(c.unionByName(p), "id", "left")
            .select("id", "name", "kind", F.coalesce(F.col("degree"), F.lit(0)).cast("bigint").alias("degree"),
                    F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight")))


@query("customer_cosine")
def customer_cosine(spark, sf_dir):
    e = materialize(similarity.edges(load_mart(spark, sf_dir)))
    c = similarity.customer_cosine(e)
    return c.select(CUSTOMER, similarity.NEIGHBOUR, "dot", r9(F.col("cosine")).alias("cosine"))


NEIGHBOURS = 10
SIMILAR_FROM = 0.25


@query("nearest_customers")
def nearest_customers(spark, sf_dir):
    e = materialize(similarity.edges(load_mart(spark, sf_dir)))
    c = neighbours.nearest_customers(e, NEIGHBOURS)
    return c.select(CUSTOMER, "rank", similarity.NEIGHBOUR, r9(F.col("cosine")).alias("cosine"))


@query("similar_customers")
def similar_customers(spark, sf_dir):
    e = materialize(similarity.edges(load_mart(spark, sf_dir)))
    c = neighbours.similar_customers(e, SIMILAR_FROM)
    return c.select(CUSTOMER, similarity.NEIGHBOUR, r9(F.col("cosine")).alias("cosine"))


def graph_scores(m, per_line_norm=False):
    # the edge table is read by weights, norms and spend: derive it once (a join of
    # lines and orders plus two semi-joins)
    recs = similarity.graph_scores(materialize(similarity.edges(m)), per_line_norm=per_line_norm)
    # sums of similarity x spend are order-dependent in the last bits: cents
    return recs.select(CUSTOMER, STYLE, r2(F.col("score")).alias("score"))


@query("graph_recs")
def graph_recs(spark, sf_dir):
    return graph_scores(load_mart(spark, sf_dir))


@query("graph_recs_line_norm")
def graph_recs_line_norm(spark, sf_dir):
    return graph_scores(load_mart(spark, sf_dir), per_line_norm=True)


# --- segments with a stored centre table (T4, A12, R7-R9) -----------------------
# The embeddings table stands in for a saved segment model: each row is a
# centre, its first d components (d = width of the default feature vector)
# scaled to the range of z-scores.

CENTRE_SCALE = 10.0
SEGMENT_FEATURES = features.DEFAULT_FEATURES


def stored_segments(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    vec = materialize(features.feature_vectors(m, SEGMENT_FEATURES), "vectors")
    dim = vec.select(F.size("values")).first()[0]
    emb = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    centres = segments.centres_from_table(emb, "vec_id", "embedding", dim, CENTRE_SCALE)
    nearest, pops, assignment = segments.segment_model(vec, centres)
    return m, nearest, pops, assignment


@query("nearest_segment")
def nearest_segment(spark, sf_dir):
    _, nearest, _, _ = stored_segments(spark, sf_dir)
    return nearest.select(CUSTOMER, "nearest", F.round("distance", 6).alias("distance"))


@query("segment_population")
def segment_population(spark, sf_dir):
    return stored_segments(spark, sf_dir)[2]


def stored_assignment(spark, sf_dir):
    m, _, _, assignment = stored_segments(spark, sf_dir)
    return m, assignment


@query("segment_fallback")
def segment_fallback(spark, sf_dir):
    return stored_assignment(spark, sf_dir)[1]


@query("segment_recs")
def segment_recs(spark, sf_dir):
    m, a = stored_assignment(spark, sf_dir)
    return segments.segment_recommendations(m.invoices, a)


# --- trained models (R3-R6, S12, S13) ----------------------------------------------
# Starts are hashes of seed and ids, so SQL can state the training: of K-means at every
# size, of ALS for two factors (a 2 x 2 solve); larger ranks are tested against NumPy.

KMEANS_K, KMEANS_ITER, SEED = 100, 7, 42


@query("kmeans_centres")
def kmeans_centres(spark, sf_dir):
    """The centres of ten segments at the start and after each of three steps."""
    m = load_mart(spark, sf_dir)
    vec, slots = features.vectors_with_slots(m, SEGMENT_FEATURES)
    every = tuple(s for n in SEGMENT_FEATURES for s in slots[n])
    kept = kmeans.fit(kmeans.stored(vec), [kmeans.Spec(10, every, (0, 1, 2, 3), SEED)])[0]
    rows = [(step, i, j, float(x)) for step, c in kept.items() for i, v in enumerate(c) for j, x in enumerate(v)]
    return spark.createDataFrame(rows, "step int, segment int, slot int, value double").withColumn("value", F.round("value", 6))


@query("kmeans_recs")
def kmeans_recs(spark, sf_dir):
    """The best styles of every customer from trained segments."""
    m = load_mart(spark, sf_dir)
    vec, slots = features.vectors_with_slots(m, SEGMENT_FEATURES)
    vec, every = kmeans.stored(vec), tuple(s for n in SEGMENT_FEATURES for s in slots[n])
    centres = kmeans.fit(vec, [kmeans.Spec(KMEANS_K, every, (KMEANS_ITER,), SEED)])[0][KMEANS_ITER]
    assigned = kmeans.assign(vec, [(every, centres)], segments.MIN_POPULATION)
    recs = segments.segment_top_k(m.invoices, assigned, REPORT_K)
    return recs.select(CUSTOMER, F.col("rank").cast("int"), STYLE, "score")


def als_recs(spark, sf_dir, implicit):
    m = load_mart(spark, sf_dir)
    p = factors.IMPLICIT_DEFAULTS if implicit else factors.EXPLICIT_DEFAULTS
    spec = als.Spec(p["rank"], p["reg"], (p["max_iter"],), implicit, p.get("alpha", 1.0))
    r = materialize(factors.ratings(m.invoices), "ratings")                # a row per customer and style it bought
    model = als.fit(r, [spec], SEED)[p["max_iter"]]
    return ranked(als.recommend(model, r, TOP_K)).drop("run_id")


def ranked(recs):
    top = postfilter.top_k(recs, TOP_K, partition=("run_id", CUSTOMER))
    return top.select("run_id", CUSTOMER, F.col("rank").cast("int"), STYLE, "score")


@query("als_explicit_recs")
def als_explicit_recs(spark, sf_dir):
    """The best unowned styles by explicit factors (rank 50)."""
    return als_recs(spark, sf_dir, implicit=False)


@query("als_implicit_recs")
def als_implicit_recs(spark, sf_dir):
    """The best unowned styles by implicit factors (rank 200)."""
    return als_recs(spark, sf_dir, implicit=True)


def small_als(spark, sf_dir):
    """Explicit and implicit factors of rank 2, trained in one loop."""
    r = materialize(factors.ratings(load_mart(spark, sf_dir).invoices), "ratings")
    specs = [als.Spec(p["rank"], p["reg"], (p["max_iter"],), p["implicit"], p.get("alpha", 1.0)) for p in tune.SMALL_CF_SETS]
    return r, als.fit(r, specs, SEED)[3]


@query("als_factors")
def als_factors(spark, sf_dir):
    """Two factors of every customer and style after three iterations; explicit
    style factors have the scale of money."""
    _, model = small_als(spark, sf_dir)
    out = None
    for run in (0, 1):
        users, items = als.factor_tables(model, run)
        for side, t, key, f in (("customer", users, CUSTOMER, "uf"), ("style", items, STYLE, "vf")):
            digits = 2 if (run, side) == (0, "style") else 6
            rows = t.select(F.lit(run).alias("run_id"), F.lit(side).alias("side"), F.col(key).cast("string").alias("key"),
                            F.round(F.get(f, 0), digits).alias("f1"), F.round(F.get(f, 1), digits).alias("f2"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("als_recs_small")
def als_recs_small(spark, sf_dir):
    """The best unowned styles by two explicit and by two implicit factors."""
    r, model = small_als(spark, sf_dir)
    return ranked(als.recommend(model, r, TOP_K, [(0, 0), (1, 1)], digits=[2, 6]))


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Models trained, saved to the shared folder, loaded and used: every customer's
    nearest of ten segments, and the predicted rating of every rated pair."""
    m = load_mart(spark, sf_dir)
    vec, slots = features.vectors_with_slots(m, SEGMENT_FEATURES)
    every = tuple(s for n in SEGMENT_FEATURES for s in slots[n])
    centres = kmeans.fit(kmeans.stored(vec), [kmeans.Spec(10, every, (5,), SEED)])[0][5]
    path = scratch_path(spark, "models")
    kmeans.save(kmeans.centre_table(spark, centres), SEGMENT_FEATURES, f"{path}/kmeans")
    r, model = small_als(spark, sf_dir)
    als.save(model, f"{path}/als")
    table, names = kmeans.load(spark, f"{path}/kmeans")
    again = materialize(features.feature_vectors(m, names).select(CUSTOMER, "values"), "vectors")
    near = segments.nearest_centres(again, table)
    users, items = als.factor_tables(als.load(spark, f"{path}/als"), 0)
    rated = factors.factor_predictions(r, users, items)
    return near.select(F.lit("segment").alias("kind"), CUSTOMER, F.col("nearest").cast("string").alias("key"),
                       F.round("distance", 6).alias("value")).unionByName(
        rated.select(F.lit("rating").alias("kind"), CUSTOMER, F.col(STYLE).alias("key"), F.round("score", 2).alias("value")))


# --- ratings and given factors (R2, R5) -----------------------------------------
# The embeddings table stands in for a stored factor model: a customer's factor
# is the first half of the vector with vec_id = customer id modulo the number of
# vectors, a style's factor the second half of that of its dictionary index, likewise.

FACTOR_DIM = 32


@query("rating_table")
def rating_table(spark, sf_dir):
    return factors.ratings(load_mart(spark, sf_dir).invoices)


@query("factor_scores")
def factor_scores(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    r = materialize(factors.ratings(m.invoices), "ratings")           # read by both dictionaries and the scores
    emb = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    n = F.lit(emb.count())
    users = (r.select(CUSTOMER).distinct().join(emb, F.pmod(F.col(CUSTOMER), n) == F.col("vec_id"))
             .select(CUSTOMER, F.slice("embedding", 1, FACTOR_DIM).alias("uf")))
    idx = features.category_dictionary(r, STYLE).select(F.col("value").alias(STYLE), "slot")
    items = (idx.join(emb, F.pmod(F.col("slot"), n) == F.col("vec_id"))
             .select(STYLE, F.slice("embedding", FACTOR_DIM + 1, FACTOR_DIM).alias("vf")))
    p = factors.factor_predictions(r, users, items)
    return p.select(CUSTOMER, STYLE, r9(F.col("score")).alias("score"))


# --- evaluation (V1-V7) -------------------------------------------------------------

def mba_suggestions(m):
    """The relevance score only looks at each customer's top 10 unowned
    styles, so the top-10 plan gives the same score as the full list."""
    return basket.basket_top_k(m.invoices, TOP_K, score_digits=9).select(CUSTOMER, STYLE, "score")


@query("relevance_by_customer")
def relevance_by_customer(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    v = evaluate.relevance_by_customer(mba_suggestions(m), m.invoices, m.products)
    return v.select(CUSTOMER, F.col("n_suggestions").cast("bigint"), "earned",
                    r9(F.col("relevance")).alias("relevance"))


def _cohort_score(per_customer):
    return evaluate.relevance_score(per_customer).select(
        F.col("customers").cast("bigint"), r9(F.col("relevance")).alias("relevance"))


@query("relevance_mba")
def relevance_mba(spark, sf_dir):
    m = load_mart(spark, sf_dir)
    return _cohort_score(evaluate.relevance_by_customer(mba_suggestions(m), m.invoices, m.products))


@query("relevance_graph")
def relevance_graph(spark, sf_dir):
    """The score only looks at each customer's top 10 unowned styles: the top-10 plan gives it."""
    m = load_mart(spark, sf_dir)
    top = similarity.graph_top_k(materialize(similarity.edges(m)), m.invoices, TOP_K, 2).select(CUSTOMER, STYLE, "score")
    return _cohort_score(evaluate.relevance_by_customer(top, m.invoices, m.products))


def scored_sets(spark, runs, m, param_sets):
    """V2 per parameter set: the customers scored (none: 0) and their mean relevance."""
    scored = tune.score_runs(runs, m).drop("params")
    return (tune.run_table(spark, param_sets).join(scored, "run_id", "left")
            .select("run_id", "params", F.coalesce("customers", F.lit(0).cast("bigint")).alias("customers"), "relevance"))


def scored_kmeans(spark, sf_dir, param_sets):
    m = load_mart(spark, sf_dir)
    return scored_sets(spark, tune.kmeans_runs(spark, m, param_sets, seed=SEED), m, param_sets)


def scored_als(spark, sf_dir, param_sets):
    m = load_mart(spark, sf_dir)
    return scored_sets(spark, tune.als_runs(m, param_sets, seed=SEED), m, param_sets)


@query("relevance_cf")
def relevance_cf(spark, sf_dir):
    """V5: explicit and implicit ALS at their defaults."""
    return scored_als(spark, sf_dir, tune.DEFAULT_CF_SETS)


@query("relevance_cf_small")
def relevance_cf_small(spark, sf_dir):
    """V5 for two factors."""
    return scored_als(spark, sf_dir, tune.SMALL_CF_SETS)


@query("relevance_kmc")
def relevance_kmc(spark, sf_dir):
    """V6: K-means at its defaults."""
    return scored_kmeans(spark, sf_dir, tune.DEFAULT_KMEANS_SETS)


@query("sweep_kmeans")
def sweep_kmeans(spark, sf_dir, param_sets=tune.KMEANS_SETS):
    """V9: all 180 parameter sets, as one model per number of clusters."""
    return scored_kmeans(spark, sf_dir, param_sets)


@query("sweep_als")
def sweep_als(spark, sf_dir, param_sets=tune.CF_SETS):
    """V8: all 81 implicit parameter sets, as 27 models kept at three iteration counts."""
    return scored_als(spark, sf_dir, param_sets)


@query("sweep_features")
def sweep_features(spark, sf_dir, param_sets=tune.FEATURE_SETS):
    """All pairs of the 13 candidate features."""
    return scored_kmeans(spark, sf_dir, param_sets)


# --- reports and export (S10-S14, R14) ------------------------------------------------

def filtered_segment_recs(spark, sf_dir, live_only):
    """Each customer's ``REPORT_K`` best styles after the tag and recency filters, and
    among the live styles if so asked."""
    m, a = stored_assignment(spark, sf_dir)

    def keep(styles):
        styles = postfilter.exclude_tags(styles, m.mixes, EXCLUDED_TAGS)
        return styles.join(m.products.select(STYLE), STYLE, "left_semi") if live_only else styles

    return m, segments.segment_top_k(m.invoices, a, REPORT_K, RECENCY_MONTHS, AS_OF, keep=keep).drop("rank")


@query("suggestion_report")
def suggestion_report(spark, sf_dir):
    m, recs = filtered_segment_recs(spark, sf_dir, live_only=True)
    r = report.suggestion_report(recs, m.products, m.mixes, m.customers, k=REPORT_K, is_money=True)
    return r.withColumn("rank", F.col("rank").cast("int"))


@query("export_recommendations")
def export_recommendations(spark, sf_dir):
    m, recs = filtered_segment_recs(spark, sf_dir, live_only=False)
    top = postfilter.top_k(postfilter.best_per_style(recs), REPORT_K)
    # A table of its own in the session's warehouse, exported twice as after a retry, returned as read from it
    name = f"recommendations_{uuid.uuid4().hex}"
    top = materialize(top, "export")
    for _ in range(2):
        sinks.replace_recommendations(top, name, AS_OF)
    return sinks.exported(spark, name, AS_OF)


# --- reference-layout CSV files (S1, S6, S9) -------------------------------------

def file_mart(spark, sf_dir):
    """The mart written as the reference's five CSV files into the shared
    folder, then read back with declared schemas and the source filters."""
    path = scratch_path(spark, "csv-mart")
    files.write_file_mart(load_raw_mart(spark, sf_dir), path)
    return files.read_file_mart(spark, path)


@query("csv_spend_stats")
def csv_spend_stats(spark, sf_dir):
    s = features.spend_stats(file_mart(spark, sf_dir).invoices)
    return s.select(CUSTOMER, "total_spend", F.col("lines").cast("bigint"),
                    r9(F.col("avg_spend")).alias("avg_spend"))


@query("csv_product_tags")
def csv_product_tags(spark, sf_dir):
    """Tags per style from the tag CSV."""
    t = report.style_tags(file_mart(spark, sf_dir).mixes)
    return t.select(STYLE, "tags", F.col("n_tags").cast("bigint"))


@query("csv_household_features")
def csv_household_features(spark, sf_dir):
    m = file_mart(spark, sf_dir)
    return features.customer_households(m.customers, m.households)
