"""Wide-column writes: one cell per row key, column family and qualifier."""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.folders import Folder

# First and last row key between which a new table is divided evenly.
FIRST_KEY, LAST_KEY = "aaaaaaa", "zzzzzzz"
#: Row keys that are looked at to divide a table by its own keys.
SAMPLE = 20_000
_SPLITS = "_splits.json"


def split_keys(regions: int, first: str = FIRST_KEY, last: str = LAST_KEY) -> list[str]:
    """The row keys at which a new table is divided into ``regions`` regions."""
    if regions < 2:
        return []
    width = max(len(first), len(last))
    low = int.from_bytes(first.encode().ljust(width, b"\0"), "big")
    high = int.from_bytes(last.encode().ljust(width, b"\0"), "big")
    cuts = (low + (high - low) * i // regions for i in range(1, regions))
    # Bytes beyond ASCII cannot be part of a text key; the nearest one below can.
    return [bytes(min(b, 127) for b in cut.to_bytes(width, "big")).decode() for cut in cuts]


def sampled_split_keys(rowkeys: DataFrame, regions: int, sample: int = SAMPLE) -> list[str]:
    """The row keys that divide the keys of a table (one column) into ``regions`` regions of about equal size.

    They are quantiles of the ``sample`` keys with the smallest hashes, one of
    each kind, so they are the same in every run and repeats of a key do not
    count. With so many, a region differs from its share by a few percent.
    """
    if regions < 2:
        return []
    key = F.col(rowkeys.columns[0]).cast("string").alias("rowkey")
    keys = rowkeys.select(key).where(F.col("rowkey").isNotNull()).distinct()
    rows = keys.orderBy(F.xxhash64("rowkey"), "rowkey").limit(sample).collect()
    found = sorted((r.rowkey for r in rows), key=lambda k: k.encode())
    cuts = [found[len(found) * i // regions] for i in range(1, regions)] if found else []
    return sorted(set(cuts), key=lambda k: k.encode())


def region_of(rowkey: Column, splits: list[str]) -> Column:
    """Number of the region that holds a row key."""
    region = F.when(rowkey.isNull(), None)
    for number, split in enumerate(splits):
        region = region.when(rowkey < F.lit(split), number)
    return region.otherwise(len(splits)).cast("int")


def cells(df: DataFrame, catalog: str) -> DataFrame:
    """The cells of a table under a JSON catalog that maps columns to families.

    A NULL is no cell. The column named as row key becomes the key of all cells.
    """
    mapping = json.loads(catalog)["columns"]
    key = row_key(catalog)
    entries = [
        F.struct(
            F.lit(place["cf"]).alias("cf"),
            F.lit(place["col"]).alias("qualifier"),
            F.col(name).cast("string").alias("value"),
        )
        for name, place in mapping.items()
        if place["cf"] != "rowkey"
    ]
    return (
        df.select(F.col(key).cast("string").alias("rowkey"), F.explode(F.array(*entries)).alias("c"))
        .select("rowkey", "c.cf", "c.qualifier", "c.value")
        .filter("value IS NOT NULL")
    )


def write_wide_column(
    df: DataFrame,
    catalog: str,
    path: str,
    regions: int = 5,
    splits: list[str] | None = None,
) -> None:
    """Write the cells of a table, divided into regions and column families.

    Without ``splits`` a new table is divided evenly between the first and the
    last key there may be; :func:`sampled_split_keys` gives splits by the keys
    there are. The splits are written beside the cells for those who read a
    stretch of keys.

    The rebalance brings the rows of a region and family together but splits a
    large one over several tasks and files, so neither the number of regions nor
    a busy one limits the parallelism of the write.
    """
    splits = split_keys(regions) if splits is None else splits
    (
        cells(df, catalog)
        .withColumn("region", region_of(F.col("rowkey"), splits))
        .hint("rebalance", "region", "cf")
        .sortWithinPartitions("region", "cf", "rowkey", "qualifier")
        .write.mode("overwrite")
        .partitionBy("region", "cf")
        .parquet(path)
    )
    Folder(df.sparkSession, path).publish(_SPLITS, json.dumps(splits))


def row_key(catalog: str) -> str:
    """The column that a JSON catalog names as row key."""
    mapping = json.loads(catalog)["columns"]
    return next(name for name, place in mapping.items() if place["cf"] == "rowkey")


def read_wide_column(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """The cells of a table, or of the row keys from ``first`` up to and with ``last``.

    Only the regions that such keys can be in are read, and in them only the row
    groups, as a region is sorted by key.
    """
    schema = "rowkey string, qualifier string, value string, region int, cf string"
    found = spark.read.schema(schema).parquet(path).select(
        "rowkey", "cf", "qualifier", "value", "region"
    )
    if first is None and last is None:
        return found
    splits = [s.encode() for s in json.loads(Folder(spark, path).read(_SPLITS))]
    if first is not None:
        found = found.where((F.col("region") >= bisect_right(splits, first.encode())) & (F.col("rowkey") >= first))
    if last is not None:
        found = found.where((F.col("region") <= bisect_right(splits, last.encode())) & (F.col("rowkey") <= last))
    return found


def read_row(spark: SparkSession, path: str, rowkey: str) -> DataFrame:
    """The cells of one row; one region is read."""
    return read_wide_column(spark, path, rowkey, rowkey)
