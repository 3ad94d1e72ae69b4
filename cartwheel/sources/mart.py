"""The sales mart: five logical tables as DataFrames with declared columns.

``load_mart`` maps the driver's TPC-H-like parquet tables onto the mart
(customers, invoices, households, products, tags). Only this module knows that
mapping; every operator works on the mart columns and nothing else:

======== ===================================================================
table    columns
======== ===================================================================
customers customer_id long, name, status, zip, common_customer int, channel,
          credit_type, online_flag, active_date (``m/d/yyyy`` or ``#N/A``)
invoices  customer_id long, style_id, ref_id int, invoice_date date,
          quantity double, unit_price double, spend decimal(18,2)
products  style_id, ref_id int, style_name, prod_desc, sub_category,
          high_category, pile_weight double, intro_date (ISO text), status
mixes     style_id, ref_id int, mix
households geo_id, simple_life, family_life, elite, active_adult_elite,
          renters (text numbers with thousands commas)
======== ===================================================================

A product is the pair (style_id, ref_id); suggestions are per style.
The ``Mart`` holds the filtered source tables (S2, S4, S7): customers not
closed, invoice lines with positive spend, products live and named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

CUSTOMER, STYLE, REF = "customer_id", "style_id", "ref_id"
ITEM = [STYLE, REF]

# The five household demographics of the reference's zip table,
# in its column order, and their column names here.
DEMOGRAPHICS = ["Simple Life", "Family Life", "Elite", "Active Adult Elite", "Renters"]
DEMOGRAPHIC_COLUMNS = ["simple_life", "family_life", "elite", "active_adult_elite", "renters"]
# Stand-in only: which market segment counts as which demographic.
SEGMENT_TO_DEMOGRAPHIC = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@dataclass(frozen=True)
class Mart:
    customers: DataFrame
    invoices: DataFrame
    households: DataFrame
    products: DataFrame
    mixes: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _style_of(partkey) -> tuple:
    return (F.floor(partkey / F.lit(4.0)).cast("bigint").cast("string").alias(STYLE),
            (partkey % 4).cast("int").alias(REF))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All products, any status."""
    p = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        *_style_of(p),
        F.col("p_name").alias("style_name"),
        F.col("p_name").alias("prod_desc"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_type").alias("high_category"),
        F.col("p_size").cast("double").alias("pile_weight"),
        F.concat((F.lit(1995) + p % 7).cast("string"), F.lit("-01-01")).alias("intro_date"),
        F.when(p % 29 == 0, F.lit("D")).otherwise(F.lit("A")).alias("status"))


def live_products(products: DataFrame) -> DataFrame:
    """Drop a lone-quote name and discontinued status."""
    return products.filter((F.col("style_name") != F.lit('"')) & (F.col("status") != F.lit("D")))


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines with the derived spend, before the spend filter."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                                 "l_extendedprice")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias(CUSTOMER),
        *_style_of(F.col("l_partkey")),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("spend"))


def positive_spend(invoices: DataFrame) -> DataFrame:
    """Returns and credits (spend <= 0) are dropped."""
    return invoices.filter(F.col("spend") > 0)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers with status and activation date, any status."""
    c = _read(spark, sf_dir, "customer")
    first = (_read(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").cast("date").alias("first_order")))
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    d = F.col("first_order")
    active = (F.when((key % 50 == 0) | d.isNull(), F.lit("#N/A"))
              .otherwise(F.concat_ws("/", F.month(d).cast("string"), F.dayofmonth(d).cast("string"),
                                     F.year(d).cast("string"))))
    return (c.join(first, c.c_custkey == first.o_custkey, "left").select(
        key.alias(CUSTOMER),
        F.col("c_name").alias("name"),
        F.when(bal < 0, F.lit("D")).when(key % 10 == 0, F.lit("Z")).otherwise(F.lit("A")).alias("status"),
        F.col("c_nationkey").cast("string").alias("zip"),
        (key % 3).cast("int").alias("common_customer"),
        F.col("c_mktsegment").alias("channel"),
        F.when(key % 17 == 0, F.lit(None).cast("string")).when(bal < 0, F.lit("NEG"))
         .when(bal < 5000, F.lit("LOW")).otherwise(F.lit("HIGH")).alias("credit_type"),
        (key % 2).cast("string").alias("online_flag"),
        active.alias("active_date")))


def open_customers(customers: DataFrame) -> DataFrame:
    """``status != 'D'``; a null status is dropped as well."""
    return customers.filter(F.col("status") != F.lit("D"))


def raw_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product tags, 0 to 2 per product."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    first = p.filter(k % 10 != 0).select(
        *_style_of(k), F.concat(F.lit("MIX_"), (F.col("p_size") % 5).cast("string")).alias("mix"))
    second = p.filter((k % 3 == 0) & (k % 10 != 0)).select(
        *_style_of(k), F.concat(F.lit("MIX_"), (F.lit(5) + k % 7).cast("string")).alias("mix"))
    return first.unionByName(second)


def raw_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic counts per zip as text with thousands commas."""
    c = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    counts = (c.groupBy(F.col("c_nationkey").cast("string").alias("geo_id"))
              .pivot("c_mktsegment", SEGMENT_TO_DEMOGRAPHIC).count().na.fill(0))
    return counts.select(
        "geo_id",
        *[F.format_number(F.col(seg) * 1000, 0).alias(name)
          for seg, name in zip(SEGMENT_TO_DEMOGRAPHIC, DEMOGRAPHIC_COLUMNS)])


def load_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The filtered mart over the driver tables in ``sf_dir``."""
    return Mart(
        customers=open_customers(raw_customers(spark, sf_dir)),
        invoices=positive_spend(raw_invoices(spark, sf_dir)),
        households=raw_households(spark, sf_dir),
        products=live_products(raw_products(spark, sf_dir)),
        mixes=raw_mixes(spark, sf_dir),
    )


def load_raw_mart(spark: SparkSession, sf_dir: str) -> Mart:
    """The mart before its source filters (S2, S4, S7), as the files hold it."""
    return Mart(customers=raw_customers(spark, sf_dir), invoices=raw_invoices(spark, sf_dir),
                products=raw_products(spark, sf_dir), mixes=raw_mixes(spark, sf_dir),
                households=raw_households(spark, sf_dir))
