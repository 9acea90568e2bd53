"""A rank over all rows without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.session import materialise


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 1) in the order of the columns: range partitions, their sizes, and places inside them."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + inside).drop("_p", "_before")
