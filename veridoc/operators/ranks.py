"""Numbers of rows in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settle


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its rank from 0 in an order without ties: sorted by ranges, numbered in each, and each range begins
    where the ones before end. A row for each range is all that is gathered."""
    ranges = settle(df.sort(*order).withColumn("__range", F.spark_partition_id()), "sorted")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__begin"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__within", within).join(F.broadcast(begins), "__range").withColumn(name, F.col("__begin") + F.col("__within") - 1).drop("__range", "__within", "__begin")
