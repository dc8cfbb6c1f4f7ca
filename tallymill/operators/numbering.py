"""Numbers for the distinct values of a column, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import checkpoint


def dense_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """The distinct values of a column, numbered from 0 in their order.

    The values are cut into ranges; each range is numbered for itself, and a
    table with one row per range says how many values lie before it. NULL gets
    no number. The result is written once, so the numbers are the same whenever
    it is read.
    """
    values = df.select(F.col(column).alias(column)).where(F.col(column).isNotNull()).distinct()
    ranged = checkpoint(values.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    numbered = ranged.withColumn("_within", within).join(sizes, "_range")
    return checkpoint(numbered.select(column, (F.col("_before") + F.col("_within") - 1).alias(name)))
