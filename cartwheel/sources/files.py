"""CSV sources in the reference's file layout.

Five files with a header row; columns are read with a declared schema (no
inference pass over the data) and renamed to the mart's names. The source
filters are the same as for the mart: open customers, positive spend, live
named products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .mart import Mart, live_products, open_customers, positive_spend

# The reference's file names and column names.
FILES = {
    "customers": "customer.csv",
    "invoices": "orderinv_line.csv",
    "households": "homeowner_zip.csv",
    "products": "sell_style.csv",
    "mixes": "MixStyle.csv",
}
SCHEMAS = {
    "customers": "CUSTOMER_NO long, BILL_TO_NAME string, CUSTOMER_STATUS_CD string, zip string, "
                 "COMMON_CUSTOMER int, channel string, CREDIT_TYPE string, SHWONL_FLAG string, "
                 "ACTIVE_DATE string",
    "invoices": "CUSTOMER_NO long, SELLING_STYLE_NO string, CUST_REF_NO int, INVOICE_DATE date, "
                "QUANTITY double, UNIT_PRICE double",
    "households": "`Geography Id` string, `Simple Life` string, `Family Life` string, Elite string, "
                  "`Active Adult Elite` string, Renters string",
    "products": "SELLING_STYLE_NO string, CUST_REF_NO int, SELLING_STYLE_NAME string, PROD_DESC string, "
                "CHO_SUB_CAT string, CPT_HDS_OTH string, PILE_WEIGHT double, SELL_INTRO_DATE string, "
                "SELLING_STATUS_CD string",
    "mixes": "SellStyleNo string, CustomerRefNo int, Mix string",
}
RENAMES = {
    "customers": {"CUSTOMER_NO": "customer_id", "BILL_TO_NAME": "name", "CUSTOMER_STATUS_CD": "status",
                  "zip": "zip", "COMMON_CUSTOMER": "common_customer", "channel": "channel",
                  "CREDIT_TYPE": "credit_type", "SHWONL_FLAG": "online_flag", "ACTIVE_DATE": "active_date"},
    "invoices": {"CUSTOMER_NO": "customer_id", "SELLING_STYLE_NO": "style_id", "CUST_REF_NO": "ref_id",
                 "INVOICE_DATE": "invoice_date", "QUANTITY": "quantity", "UNIT_PRICE": "unit_price"},
    "households": {"Geography Id": "geo_id", "Simple Life": "simple_life", "Family Life": "family_life",
                   "Elite": "elite", "Active Adult Elite": "active_adult_elite", "Renters": "renters"},
    "products": {"SELLING_STYLE_NO": "style_id", "CUST_REF_NO": "ref_id", "SELLING_STYLE_NAME": "style_name",
                 "PROD_DESC": "prod_desc", "CHO_SUB_CAT": "sub_category", "CPT_HDS_OTH": "high_category",
                 "PILE_WEIGHT": "pile_weight", "SELL_INTRO_DATE": "intro_date", "SELLING_STATUS_CD": "status"},
    "mixes": {"SellStyleNo": "style_id", "CustomerRefNo": "ref_id", "Mix": "mix"},
}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header row; declared schema, or inferred if none."""
    reader = spark.read.option("header", "true")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", "true")
    return reader.csv(path)


def _renamed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in RENAMES[table].items()])


def read_file_mart(spark: SparkSession, base_dir: str) -> Mart:
    """The mart from the five reference-layout CSV files under ``base_dir``."""
    t = {name: _renamed(read_csv(spark, f"{base_dir.rstrip('/')}/{f}", SCHEMAS[name]), name)
         for name, f in FILES.items()}
    inv = t["invoices"].withColumn(
        "spend", (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)"))
    return Mart(customers=open_customers(t["customers"]), invoices=positive_spend(inv),
                households=t["households"], products=live_products(t["products"]), mixes=t["mixes"])


def write_file_mart(mart: Mart, base_dir: str) -> None:
    """The mart as the five reference-layout CSV files (for round trips)."""
    for name, f in FILES.items():
        df = getattr(mart, name)
        inverse = {dst: src for src, dst in RENAMES[name].items()}
        df.select(*[F.col(dst).alias(src) for dst, src in inverse.items()]).write.mode("overwrite") \
            .option("header", "true").csv(f"{base_dir.rstrip('/')}/{f}")
