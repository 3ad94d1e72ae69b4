"""Parameter sweeps scored with the relevance score.

The grid is a plain list of parameter sets. All sets of a technique are trained in
one loop of Spark jobs, whatever their number; sets that differ in their iteration
count alone share a model. The top suggestions of all runs are written once to the
shared checkpoint folder and scored by one relevance query over that table.
Only the top ``SCORE_TOP_K`` unowned styles of each customer can reach the
score, so writing just those keeps the result exact.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard, materialize
from ..sources.mart import CUSTOMER, Mart
from . import als, evaluate, factors, features, kmeans, postfilter, segments

# The reference's sweep grids.
CF_GRID = dict(rank=[200, 300, 400], max_iter=[15, 20, 25], reg=[0.1, 0.5, 1.0], alpha=[0.01, 0.05, 0.1])
KMEANS_ITERATIONS = [1, 2, 5, 7, 9, 10, 15, 20, 25]
KMEANS_CLUSTERS = list(range(10, 201, 10))
FACTORS_AT_A_TIME = 1024      # of an id, in one loop of ALS
DIMENSION_CANDIDATES = ["zip", "StyleYear", "Active Adult Elite", "ACTIVE_DATE", "CHO_SUB_CAT", "Mix",
                        "AverageExpenditure", "CPT_HDS_OTH", "PROD_DESC", "Elite", "Simple Life",
                        "Family Life", "COMMON_CUSTOMER"]


def grid(**values: list) -> list[dict]:
    """Every combination of the given parameter values."""
    keys = list(values)
    return [dict(zip(keys, combo)) for combo in itertools.product(*values.values())]


def feature_subsets(names: list[str], r: int) -> list[list[str]]:
    """All subsets of ``r`` features, in catalog order."""
    return [list(c) for c in itertools.combinations(names, r)]


#: The registered sweeps of K-means: all parameter sets (V9), all pairs of features.
KMEANS_SETS = grid(max_iter=KMEANS_ITERATIONS, k=KMEANS_CLUSTERS)
FEATURE_SETS = [dict(k=100, max_iter=7, names=s) for s in feature_subsets(DIMENSION_CANDIDATES, 2)]
#: The registered sweep of ALS: the whole grid of V8.
CF_SETS = [dict(p, implicit=True) for p in grid(**CF_GRID)]
#: Two factors, of which SQL can state every step.
SMALL_CF_SETS = [dict(rank=2, max_iter=3, reg=0.1, implicit=False), dict(rank=2, max_iter=3, reg=0.1, alpha=0.01, implicit=True)]
DEFAULT_CF_SETS = [dict(factors.EXPLICIT_DEFAULTS, implicit=False), dict(factors.IMPLICIT_DEFAULTS, implicit=True)]
DEFAULT_KMEANS_SETS = [dict(k=100, max_iter=7)]


def params_text(params: dict) -> str:
    """A parameter set as the text in the column ``params``."""
    return json.dumps(params, sort_keys=True)


def kmeans_runs(spark: SparkSession, mart: Mart, param_sets: list[dict], seed: int = 0, models: int = 1) -> DataFrame:
    """Per parameter set (k, max_iter, optional feature names) the top unowned
    segment suggestions of every customer: (run_id, params, customer_id, rank, style_id, score).

    All sets are trained in one loop (``kmeans.fit``): sets that differ in ``max_iter`` alone
    are one model, whose centres are kept at each count. Customers of all runs are assigned in
    one pass and answered in one plan. With ``models`` above 1 each set is fitted that often
    with consecutive seeds (parameter ``model``); ``best_runs`` keeps the best of each set."""
    sets = [dict(p, model=i) if models > 1 else dict(p) for p in param_sets for i in range(models)]
    chosen = [tuple(p.get("names", features.DEFAULT_FEATURES)) for p in sets]
    vectors, slots = features.vectors_with_slots(mart, sorted({n for names in chosen for n in names}))
    vectors = kmeans.stored(vectors)
    wanted: dict[tuple, list[int]] = {}
    for p, names in zip(sets, chosen):
        wanted.setdefault((p["k"], names, p.get("model", 0)), []).append(p["max_iter"])
    specs = {key: kmeans.Spec(key[0], tuple(s for n in key[1] for s in slots[n]), tuple(sorted(set(iterations))), seed + key[2])
             for key, iterations in wanted.items()}
    fitted = dict(zip(specs, kmeans.fit(vectors, list(specs.values()))))
    keys = [(p["k"], names, p.get("model", 0)) for p, names in zip(sets, chosen)]
    runs = [(specs[key].slots, fitted[key][p["max_iter"]]) for p, key in zip(sets, keys)]
    assigned = materialize(kmeans.assign(vectors, runs, segments.MIN_POPULATION), "assigned-runs")
    top = segments.segment_top_k(mart.invoices, assigned, evaluate.SCORE_TOP_K, runs=("run_id",))
    return materialize(top.join(run_table(spark, sets), "run_id"), "kmeans-runs")


def run_table(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """(run_id, params): a row per parameter set."""
    return spark.createDataFrame([(i, params_text(p)) for i, p in enumerate(sets)], "run_id int, params string")


def model_groups(specs: list[als.Spec]) -> list[list[int]]:
    """Places of the models that are trained side by side: at most ``FACTORS_AT_A_TIME`` factors an id, one model at least."""
    groups: list[list[int]] = []
    for m, s in enumerate(specs):
        if not groups or sum(specs[i].rank for i in groups[-1]) + s.rank > FACTORS_AT_A_TIME:
            groups.append([])
        groups[-1].append(m)
    return groups


def als_runs(mart: Mart, param_sets: list[dict], seed: int = 0) -> DataFrame:
    """V5/V8: per parameter set (rank, max_iter, reg, implicit, alpha) the top unowned ALS
    suggestions of every customer: (run_id, params, customer_id, rank, style_id, score).

    Sets that differ in ``max_iter`` alone are one model, whose factors are kept at each count; models
    are trained in loops (``als.fit``) of a bounded number of factors."""
    keys = [(p["rank"], p["reg"], p.get("implicit", False), p.get("alpha", 1.0)) for p in param_sets]
    wanted: dict[tuple, set[int]] = {}
    for p, key in zip(param_sets, keys):
        wanted.setdefault(key, set()).add(p["max_iter"])
    specs = [als.Spec(rank, reg, tuple(sorted(iterations)), implicit, alpha)
             for (rank, reg, implicit, alpha), iterations in wanted.items()]
    place = {key: m for m, key in enumerate(wanted)}
    ratings = materialize(factors.ratings(mart.invoices), "ratings")
    found = None
    for some in model_groups(specs):
        kept = als.fit(ratings, [specs[m] for m in some], seed)
        for step, model in kept.items():
            runs = [(i, some.index(place[key])) for i, (p, key) in enumerate(zip(param_sets, keys))
                    if p["max_iter"] == step and place[key] in some]
            top = materialize(als.recommend(model, ratings, evaluate.SCORE_TOP_K, runs), "als-top")
            found = top if found is None else found.unionByName(top)
            discard(model.users)
            discard(model.items)
    top = postfilter.top_k(found, evaluate.SCORE_TOP_K, partition=("run_id", CUSTOMER))
    return materialize(top.join(run_table(mart.invoices.sparkSession, param_sets), "run_id"), "als-runs")


def score_runs(runs: DataFrame, mart: Mart) -> DataFrame:
    """V2 per run: (run_id, params, customers, relevance)."""
    per = evaluate.relevance_by_customer(runs.drop("params"), mart.invoices, mart.products, runs=("run_id",))
    named = runs.select("run_id", "params").distinct()                                 # a row per run
    return (evaluate.relevance_score(per, runs=("run_id",)).join(named, "run_id")
            .select("run_id", "params", F.col("customers").cast("bigint"), F.round("relevance", 9).alias("relevance")))


def best_runs(scored: DataFrame) -> DataFrame:
    """V9: of the models of each parameter set the one with the highest relevance
    (ties: the lower model number): (params, model, customers, relevance)."""
    kind = "map<string,string>"
    p = F.from_json("params", kind)
    rows = scored.select(F.to_json(F.map_filter(p, lambda k, _: k != "model")).alias("params"),
                         F.element_at(p, "model").cast("int").alias("model"), "customers", "relevance")
    best = F.max_by(F.struct("model", "customers", "relevance"), F.struct("relevance", -F.col("model")))
    return rows.groupBy("params").agg(best.alias("b")).select("params", "b.model", "b.customers", "b.relevance")
