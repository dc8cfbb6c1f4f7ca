"""Ranks and running totals inside keys, without a task that holds a whole key.

Rows of a key are dealt to ordered salts. Each salt is numbered for itself, and
a table with one row per key and salt says how much lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_salt(value: Column, salts: int) -> Column:
    """A salt that follows the order of a 64-bit hash."""
    return F.floor((F.shiftrightunsigned(value, 33) * F.lit(salts)) / F.lit(1 << 31)).cast("long")


def salts_for(rows: int, per_salt: int = 20_000) -> int:
    return max(1, -(-rows // per_salt))


def running_total(df: DataFrame, keys: list[str], salt: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key that come earlier.

    ``salt`` must not decrease along ``order``. A value of 1 gives the rank from
    0. Keys must not be null. Rows that ``order`` does not tell apart get places
    in any order, so it should name every column that differs.
    """
    groups = [*keys, salt]
    df = df.withColumn("_value", value.cast("long"))
    inner = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups).agg(F.sum("_value").alias("_sum"))
    outer = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_within", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
        .join(before, groups)
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_value", "_within", "_before")
    )
