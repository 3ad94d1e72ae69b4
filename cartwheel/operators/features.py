"""Customer features.

Per-customer aggregates are computed from invoice lines joined to products on
the composite key, each pre-aggregated per customer before any join, and the
19 named features of the catalog are assembled by joining those per-customer
tables on ``customer_id`` (inner by default: a customer missing any part drops
out, as in the reference). Lines are joined to products once and stored; all
share features are counted in one aggregate over them.

Feature values are kept in long form ``(customer_id, feature, slot, value)``;
a vector feature (a share over category values, a one-hot) has one slot per
dictionary entry, dictionaries ordered alphabetically. Z-scores use the
population standard deviation over all customers with complete features; a
constant slot is only centred.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import comma_number, iso_year, slash_year, str_or_empty
from ..session import materialize
from ..sources.mart import CUSTOMER, DEMOGRAPHIC_COLUMNS, DEMOGRAPHICS, ITEM, REF, STYLE, Mart
from .skew import fanout_partitions

# The reference's feature catalog, in its order, and the default
# ("best known") feature list for K-means.
FEATURE_CATALOG = ["Elite", "zip", "Renters", "COMMON_CUSTOMER", "channel", "PROD_DESC", "StyleYear",
                   "Simple Life", "Family Life", "Active Adult Elite", "CHO_SUB_CAT", "CPT_HDS_OTH",
                   "PILE_WEIGHT", "CREDIT_TYPE", "SHWONL_FLAG", "AverageExpenditure",
                   "TotalExpenditure", "Mix", "ACTIVE_DATE"]
DEFAULT_FEATURES = ["StyleYear", "AverageExpenditure", "CPT_HDS_OTH"]

# Mart column behind each catalog name.
PRODUCT_CATEGORY = {"PROD_DESC": "prod_desc", "CHO_SUB_CAT": "sub_category", "CPT_HDS_OTH": "high_category"}
CUSTOMER_CATEGORY = {"channel": "channel", "CREDIT_TYPE": "credit_type", "SHWONL_FLAG": "online_flag"}
HOUSEHOLD = dict(zip(DEMOGRAPHICS, DEMOGRAPHIC_COLUMNS))


# --- per-customer aggregates ------------------------------------------------

def lines_with_products(invoices: DataFrame, products: DataFrame, *cols: str) -> DataFrame:
    """Invoice lines joined to live products on (style, ref)."""
    return invoices.select(CUSTOMER, *ITEM).join(products.select(*ITEM, *cols), ITEM)


def dictionaries(values: DataFrame) -> DataFrame:
    """A19 for many features: the distinct rows of ``values(feature, value)``, each with
    its 0-based place in its feature in alphabetical order. They are stored in range
    partitions; a value's slot is its place in its partition after the values of its
    feature in the partitions before."""
    d = values.select("feature", "value").distinct()
    ranges = (d.repartitionByRange(fanout_partitions(values), "feature", "value")
              .withColumn("_range", F.spark_partition_id()))
    ranges = materialize(ranges, "dictionary")
    earlier = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranges.groupBy("feature", "_range").agg(F.count(F.lit(1)).alias("_n"))      # a row per feature and partition
              .select("feature", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("feature", "_range").orderBy("value")) - 1
    return (ranges.join(F.broadcast(before), ["feature", "_range"])
            .select("feature", "value", (F.col("_before") + place).cast("int").alias("slot")))


def category_dictionary(values: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` (null as ''), 0-based index in
    alphabetical order."""
    return dictionaries(values.select(F.lit(column).alias("feature"), str_or_empty(column).alias("value"))).select(
        "value", "slot")


def share_of_lines(counts: DataFrame, key: str) -> DataFrame:
    """A6 shape: (customer_id, key, n) -> share of the customer's total.
    Rows are already one per (customer, value), so the per-customer window is
    bounded by the number of distinct values."""
    total = F.sum("n").over(Window.partitionBy(CUSTOMER))
    return counts.select(CUSTOMER, key, (F.col("n") / total).alias("share"))


def category_share(invoices: DataFrame, products: DataFrame, column: str) -> DataFrame:
    """Per customer, lines in each value of a product category over all its
    lines matched to live products. Long form (customer_id, value, share)."""
    j = lines_with_products(invoices, products, column)
    counts = j.groupBy(CUSTOMER, str_or_empty(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return share_of_lines(counts, "value")


def tag_share(invoices: DataFrame, mixes: DataFrame) -> DataFrame:
    """As A6 over tags: each line counts once per tag of its product
    (denominator = tag occurrences). Long form (customer_id, value, share)."""
    j = invoices.select(CUSTOMER, *ITEM).join(mixes.select(*ITEM, "mix"), ITEM)
    counts = j.groupBy(CUSTOMER, F.col("mix").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return share_of_lines(counts, "value")


def spend_stats(invoices: DataFrame) -> DataFrame:
    """Per customer, total spend (exact decimal sum), line count and mean."""
    g = invoices.groupBy(CUSTOMER).agg(F.sum("spend").alias("total_spend"),
                                       F.count(F.lit(1)).alias("lines"))
    total = F.col("total_spend").cast("double")
    return g.select(CUSTOMER, total.alias("total_spend"), "lines",
                    (total / F.col("lines")).alias("avg_spend"))


def style_stats(invoices: DataFrame, products: DataFrame) -> DataFrame:
    """Per customer over lines matched to live products: mean and sum
    of pile weight, mean introduction year."""
    return _style_means(lines_with_products(invoices, products, "pile_weight", "intro_date"))


def _style_means(live: DataFrame) -> DataFrame:
    return live.groupBy(CUSTOMER).agg(
        F.avg("pile_weight").alias("avg_pile_weight"),
        F.sum("pile_weight").alias("total_pile_weight"),
        F.avg(iso_year("intro_date")).alias("avg_style_year"))


def customer_households(customers: DataFrame, households: DataFrame) -> DataFrame:
    """J3 + E2: customers with their zip's demographic numbers (inner join:
    a zip without household data drops the customer)."""
    h = households.select(F.col("geo_id"), *[comma_number(c).alias(c) for c in DEMOGRAPHIC_COLUMNS])
    return (customers.join(h, customers.zip == h.geo_id)
            .select(CUSTOMER, comma_number("zip").alias("zip_number"), *DEMOGRAPHIC_COLUMNS))


def one_hot(customers: DataFrame, column: str) -> DataFrame:
    """E3 in sparse long form: (customer_id, value, slot) for the one slot that
    is 1.0; the dictionary is the distinct values over all given customers."""
    d = category_dictionary(customers, column)
    return (customers.select(CUSTOMER, str_or_empty(column).alias("value"))
            .join(d, "value").select(CUSTOMER, "value", "slot"))


# --- the feature catalog ----------------------------------------------------

def _tall(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per row of ``rows`` and feature of ``columns`` (feature -> column), with
    the columns of ``rows`` that are no values: (customer_id?, feature, value)."""
    pair = [F.struct(F.lit(n).alias("feature"), str_or_empty(c).alias("value")) for n, c in columns.items()]
    keep = [c for c in (CUSTOMER,) if c in rows.columns]
    return rows.select(*keep, F.explode(F.array(*pair)).alias("_p")).select(*keep, "_p.feature", "_p.value")


def _dense(entries, size: int):
    """Array of ``size`` doubles from (slot, share) pairs, 0 where there is none."""
    e = F.array_sort(F.coalesce(entries, F.array().cast("array<struct<slot:int,share:double>>")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before = lambda i: F.coalesce(F.get(e, i - 1)["slot"], F.lit(-1))
    filled = F.flatten(F.transform(e, lambda x, i: F.concat(zeros(x["slot"] - before(i) - 1), F.array(x["share"]))))
    return F.concat(filled, zeros(F.lit(size - 1) - before(F.size(e))))


def _share_entries(tall: DataFrame, dictionary: DataFrame, names: list[str]) -> DataFrame:
    """A6, A7 for all share features in one pass: per customer and feature of
    ``names`` the (slot, share) pairs, bounded by the dictionary."""
    counts = tall.groupBy(CUSTOMER, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(CUSTOMER, "feature"))
    shares = (counts.withColumn("share", F.col("n") / total)
              .join(dictionary, ["feature", "value"]).select(CUSTOMER, "feature", "slot", "share"))
    return shares.groupBy(CUSTOMER).agg(*[
        F.collect_list(F.when(F.col("feature") == n, F.struct("slot", "share"))).alias(f"_v_{n}") for n in names])


def complete_customers(mart: Mart) -> DataFrame:
    """J4 completeness: customers that have every part of the catalog, i.e. a
    household row for their zip, a line on a live product and a line on a
    tagged product (semi-joins, no feature is computed for this)."""
    lines = mart.invoices.select(CUSTOMER, *ITEM)
    return _complete(mart, lines.join(mart.products.select(*ITEM), ITEM, "left_semi"))


def _complete(mart: Mart, live: DataFrame) -> DataFrame:
    lines = mart.invoices.select(CUSTOMER, *ITEM)
    tagged = lines.join(mart.mixes.select(*ITEM), ITEM, "left_semi").select(CUSTOMER)
    return (customer_households(mart.customers, mart.households).select(CUSTOMER)
            .join(live.select(CUSTOMER), CUSTOMER, "left_semi").join(tagged, CUSTOMER, "left_semi"))


def feature_arrays(mart: Mart, names: list[str] | None = None, how: str = "inner") -> DataFrame:
    """One row per complete customer, one array column per requested
    feature (scalars as 1-element arrays), named as the catalog.

    As in the reference, completeness is judged on every part of the catalog
    whatever ``names`` asks for; only the requested features are computed.
    ``how='left'`` keeps every customer: a missing scalar is null, missing shares
    are zeros.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    names = list(names or FEATURE_CATALOG)
    unknown = [n for n in names if n not in FEATURE_CATALOG]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    # the lines are a join of two big tables and every part reads them: stored once, as is their join to products
    mart = replace(mart, invoices=materialize(mart.invoices.select(CUSTOMER, *ITEM, "spend"), "lines"),
                   customers=materialize(mart.customers, "customers"))
    inv, prod, cust = mart.invoices, mart.products, mart.customers
    by_product = {n: c for n, c in PRODUCT_CATEGORY.items() if n in names}
    by_customer = {n: c for n, c in CUSTOMER_CATEGORY.items() if n in names}
    style = ["pile_weight", "intro_date"] if set(names) & {"PILE_WEIGHT", "StyleYear"} else []
    live = materialize(lines_with_products(inv, prod, *by_product.values(), *style), "live-lines")

    out = _complete(mart, live) if how == "inner" else cust.select(CUSTOMER)
    if set(names) & (set(HOUSEHOLD) | {"zip"}):
        out = out.join(customer_households(cust, mart.households), CUSTOMER, how)
    if set(names) & {"COMMON_CUSTOMER", "ACTIVE_DATE"} or by_customer:
        out = out.join(cust.select(CUSTOMER, "common_customer", "active_date", *by_customer.values()), CUSTOMER, how)
    if style:
        out = out.join(_style_means(live), CUSTOMER, how)
    if set(names) & {"AverageExpenditure", "TotalExpenditure"}:
        out = out.join(spend_stats(inv), CUSTOMER, how)

    # values of the categories (their dictionaries) and the lines' values, each as one tall table
    known, tall = [], []
    if by_product:
        known.append(_tall(prod, by_product).select("feature", "value"))
        tall.append(_tall(live, by_product))
    if "Mix" in names:
        known.append(_tall(mart.mixes.select("mix"), {"Mix": "mix"}))
        tall.append(_tall(inv.select(CUSTOMER, *ITEM).join(mart.mixes.select(*ITEM, "mix"), ITEM), {"Mix": "mix"}))
    if by_customer:
        known.append(_tall(cust, by_customer).select("feature", "value"))
    sizes: dict[str, int] = {}
    if known:
        dictionary = materialize(dictionaries(reduce(DataFrame.unionByName, known)), "dictionaries")
        sizes = {r["feature"]: r["n"] for r in                                        # a row per feature
                 dictionary.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    if tall:
        shared = [*by_product, *(["Mix"] if "Mix" in names else [])]
        out = out.join(_share_entries(reduce(DataFrame.unionByName, tall), dictionary, shared), CUSTOMER, "left")
    for name, col in by_customer.items():
        slots = dictionary.filter(F.col("feature") == name).select(F.col("value").alias("_value"),
                                                                   F.col("slot").alias(f"_s_{name}"))
        out = out.join(slots, str_or_empty(col) == F.col("_value"), "left").drop("_value")

    def arr(name: str):
        if name in HOUSEHOLD:
            return F.array(F.col(HOUSEHOLD[name]))
        if name == "zip":
            return F.array(F.col("zip_number"))
        if name == "COMMON_CUSTOMER":
            return F.array(F.col("common_customer").cast("double"))
        if name == "ACTIVE_DATE":
            return F.array(slash_year("active_date"))
        if name == "StyleYear":
            return F.array(F.col("avg_style_year"))
        if name == "PILE_WEIGHT":
            return F.array(F.col("avg_pile_weight"))
        if name == "AverageExpenditure":
            return F.array(F.col("avg_spend"))
        if name == "TotalExpenditure":
            return F.array(F.col("total_spend"))
        if name in CUSTOMER_CATEGORY:
            return _dense(F.when(F.col(f"_s_{name}").isNotNull(), F.array(F.struct(
                F.col(f"_s_{name}").alias("slot"), F.lit(1.0).alias("share")))), sizes.get(name, 0))
        return _dense(F.col(f"_v_{name}"), sizes.get(name, 0))

    return materialize(out.select(CUSTOMER, *[arr(n).alias(n) for n in names]), "feature-arrays")


def feature_long(arrays: DataFrame, names: list[str]) -> DataFrame:
    """Long form (customer_id, feature, slot, value) of ``feature_arrays``:
    one explode over all features of a row, so the row is read once."""
    def tagged(name):
        return lambda v, i: F.struct(F.lit(name).alias("feature"), i.cast("int").alias("slot"),
                                     v.cast("double").alias("value"))

    entries = [F.transform(F.col(f"`{n}`"), tagged(n)) for n in names]
    return (arrays.select(CUSTOMER, F.explode(F.flatten(F.array(*entries))).alias("e"))
            .select(CUSTOMER, "e.feature", "e.slot", "e.value"))


def slot_stats(long: DataFrame) -> DataFrame:
    """Mean and population stddev of every (feature, slot) over customers."""
    return long.groupBy("feature", "slot").agg(F.avg("value").alias("mean"),
                                                F.stddev_pop("value").alias("std"))


def zscore(long: DataFrame) -> DataFrame:
    """(v - mean) / stddev_pop; ``v - mean`` where the stddev is 0.
    The stats table has one row per slot, as many as a customer has values, and is
    broadcast: adaptive execution would know its size only after moving the values."""
    j = long.join(F.broadcast(slot_stats(long)), ["feature", "slot"])
    v, m, s = F.col("value"), F.col("mean"), F.col("std")
    return j.select(CUSTOMER, "feature", "slot",
                    F.when(s <= 0, v - m).otherwise((v - m) / s).alias("z"))


def feature_vectors(mart: Mart, names: list[str] | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """(customer_id, values array<double>, features vector), z-scored over
    all customers, features concatenated in the order of ``names``; the vectors of
    the customers of ``cohort`` (all when None)."""
    names = list(names or DEFAULT_FEATURES)
    return _vectors(feature_arrays(mart, names), names, cohort)


def vectors_with_slots(mart: Mart, names: list[str]) -> tuple[DataFrame, dict[str, list[int]]]:
    """``feature_vectors`` of all customers, and the places of each feature in them."""
    arrays = feature_arrays(mart, names)
    widths = arrays.select(*[F.size(f"`{n}`") for n in names]).first()
    slots, at = {}, 0
    for name, width in zip(names, widths or [0] * len(names)):
        slots[name] = list(range(at, at + width))
        at += width
    return _vectors(arrays, list(names), None), slots


def _vectors(arrays: DataFrame, names: list[str], cohort: DataFrame | None) -> DataFrame:
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    stats = slot_stats(feature_long(arrays, names)).select(order[F.col("feature")].alias("o"), "slot", "mean", "std")
    # one row, an array as wide as a vector; the subquery stays outside the lambda
    level = stats.agg(F.array_sort(F.collect_list(F.struct("o", "slot", "mean", "std")))).scalar()
    if cohort is not None:
        arrays = arrays.join(cohort.select(CUSTOMER).distinct(), CUSTOMER, "left_semi")
    rows = arrays.select(CUSTOMER, F.concat(*[F.col(f"`{n}`").cast("array<double>") for n in names]).alias("_raw"),
                         level.alias("_level"))
    z = F.zip_with("_raw", "_level", lambda v, s: F.when(s["std"] <= 0, v - s["mean"]).otherwise(
        (v - s["mean"]) / s["std"]))
    return rows.select(CUSTOMER, z.alias("values")).withColumn("features", array_to_vector("values"))
