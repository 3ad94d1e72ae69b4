"""Stored numbers for values: dense, in order, without a driver-held dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .skew import fanout_partitions


def numbered(values: DataFrame, column: str, number: str) -> DataFrame:
    """A stored bijection (column, number): distinct values, not null, in order, from 0. They are
    sorted into range partitions and counted on from the partitions before."""
    d = values.select(column).filter(F.col(column).isNotNull()).distinct()
    d = materialize(d.repartitionByRange(fanout_partitions(values), column).withColumn("_range", F.spark_partition_id()), f"{number}-ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)                # a row per partition
    before = (d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return materialize(d.join(F.broadcast(before), "_range").select(column, (F.col("_before") + place).alias(number)), f"{number}-numbers")
