"""Warehouse-shaped sources (S3, S5, S8) over the driver tables.

The reference's warehouse mode reads wider tables than its file mode: invoice
lines joined to the crediting company with a margin and several filters,
products joined to company / brand / inventory dimensions, and customers with
status 'A' or 'Z'. Here the same shapes are built from the TPC-H-like tables:

* S3 customers: status in ('A', 'Z'), with the postal code kept as ``zip``
* S5 invoice lines ⋈ supplier (the crediting company), a ``yyyymm`` month,
  net amount after discount, a cost, ``margin_pct``, and the filters
* S8 products ⋈ inventory (part-supplier pairs seen on lines) ⋈ company ⋈
  nation ⋈ region: one row per live product and company supplying it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import margin_pct
from ..sources.mart import CUSTOMER, REF, STYLE, _read, _style_of, live_products, raw_customers, raw_products

# Fixed values from the reference's warehouse query: kept divisions, the
# first month kept (exclusive) is given per query below.
DIVISIONS = ["02", "06", "32", "34", "58", "60", "63", "93", "94", "96"]
# Stand-in: free-on-board cost as a share of the list amount.
FOB_COST_SHARE = 0.7


def warehouse_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: customers with status 'A' or 'Z'."""
    return raw_customers(spark, sf_dir).filter(F.col("status").isin("A", "Z"))


def margin_lines(spark: SparkSession, sf_dir: str, after_month: str = "199512",
                 divisions: list[str] = DIVISIONS) -> DataFrame:
    """Invoice lines credited to a company, with margin, filtered:
    month after ``after_month``, non-zero net, not returned, positive spend,
    division in ``divisions``, open lines."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    year, after = int(after_month[:4]), int(after_month[4:])
    start = F.lit(f"{year + after // 12:04d}-{after % 12 + 1:02d}-01").cast(o.schema["o_orderdate"].dataType)
    o = o.filter(F.col("o_orderdate") >= start)          # the month after, as a date: reaches the scan
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey))
    d = F.col("o_orderdate")
    month = F.format_string("%04d%02d", F.year(d), F.month(d))
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_extendedprice") * F.lit(FOB_COST_SHARE)
    spend = F.col("l_extendedprice").cast("decimal(18,2)")
    division = F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
    out = j.select(
        F.col("o_custkey").alias(CUSTOMER), *_style_of(F.col("l_partkey")),
        d.cast("date").alias("invoice_date"), month.alias("invoice_month"),
        division.alias("division_id"), F.col("l_suppkey").alias("company_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        spend.alias("spend"), net.alias("net_amount"), margin_pct(net, cost).alias("margin_pct"),
        F.col("l_returnflag"), F.col("l_linestatus"))
    return (out.filter((F.col("net_amount") != 0)
                       & (F.col("l_returnflag") != "R") & (F.col("spend") > 0)
                       & F.col("division_id").isin(list(divisions)) & (F.col("l_linestatus") == "O"))
            .drop("l_returnflag", "l_linestatus"))


def product_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live products with each company supplying them, its nation and region."""
    prod = live_products(raw_products(spark, sf_dir)).withColumn(
        "_pk", F.col(STYLE).cast("bigint") * 4 + F.col(REF))
    inv = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nat = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (prod.join(inv, prod._pk == inv.l_partkey)
         .join(sup, inv.l_suppkey == sup.s_suppkey)
         .join(nat, sup.s_nationkey == nat.n_nationkey)
         .join(reg, nat.n_regionkey == reg.r_regionkey))
    return j.select(STYLE, REF, "style_name", "prod_desc", "sub_category", "high_category",
                    F.col("s_name").alias("company"), F.col("n_name").alias("nation"),
                    F.col("r_name").alias("region"))
