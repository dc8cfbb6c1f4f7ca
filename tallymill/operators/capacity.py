"""Requested cores and memory per group of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.quantities import cores, usable_mib

TOTAL = "total"


def app_capacity(specs: DataFrame) -> DataFrame:
    """Cores and heap MiB of each application: the driver and all its executors.

    Expects ``driver_cpu``, ``driver_memory``, ``executor_cpu``,
    ``executor_memory``, ``replicas`` and ``jvm``.
    """
    replicas = F.coalesce("replicas", F.lit(0))
    jvm = F.col("jvm")
    return specs.withColumn(
        "cores", cores("driver_cpu") + replicas * cores("executor_cpu")
    ).withColumn(
        "memory_mib",
        usable_mib("driver_memory", jvm) + replicas * usable_mib("executor_memory", jvm),
    )


def capacity_rollup(specs: DataFrame, group: str) -> DataFrame:
    """Applications, cores and memory per group, and a row for all of them.

    The total is rolled up from the group sums, not from the applications.
    """
    per_group = (
        app_capacity(specs)
        .groupBy(group)
        .agg(
            F.count("*").alias("apps"),
            F.sum("cores").alias("cores"),
            F.sum("memory_mib").alias("memory_mib"),
        )
    )
    return (
        per_group.rollup(group)
        .agg(
            F.grouping(group).alias("_total"),
            F.sum("apps").alias("apps"),
            F.sum("cores").alias("cores"),
            F.sum("memory_mib").alias("memory_mib"),
        )
        .withColumn(group, F.when(F.col("_total") == 1, F.lit(TOTAL)).otherwise(F.col(group)))
        .drop("_total")
    )
