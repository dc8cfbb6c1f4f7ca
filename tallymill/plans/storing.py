"""Sources and sinks: each query writes a table and reads it back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.reports import monthly_stats, weekday_report
from tallymill.plans.registry import query, table
from tallymill.plans.reporting import MONTHS, TRIPS, WEEKDAYS
from tallymill.session import scratch_path
from tallymill.sinks.cells import (
    read_row,
    read_wide_column,
    sampled_split_keys,
    split_keys,
    write_wide_column,
)
from tallymill.sinks.files import (
    overwrite_versioned,
    read_versioned,
    write_parquet,
    write_report_csv,
)
from tallymill.sinks.tables import (
    append_table,
    create_empty_table,
    create_or_replace_table,
    ensure_schema,
)
from tallymill.sources.files import read_csv, read_manifest, read_parquet, read_table
from tallymill.sources.generated import FOLD, LETTERS, STRETCH, TEXT_LENGTH, records_for
from tallymill.sources.manifests import read_large_manifest

TRIP_SCHEMA = "l_shipdate timestamp, l_quantity double, l_discount double, l_extendedprice double"


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*TRIPS.values())


@query("csv_weekday_report", WEEKDAYS)
def _csv_weekday_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taxi job as it is run: CSV in, types inferred, report out."""
    path = scratch_path(spark, "trips")
    _trips(spark, sf_dir).write.option("header", True).csv(path)
    return weekday_report(read_csv(spark, path), digits=2, **TRIPS)


@query("csv_report_file", WEEKDAYS)
def _csv_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = weekday_report(table(spark, sf_dir, "lineitem"), digits=2, **TRIPS)
    write_report_csv(report, path, order_by=["day_of_week"])
    return read_csv(spark, path)


@query("manifest_weekday_report", WEEKDAYS)
def _manifest_weekday_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of trips and a text file that names them."""
    path = scratch_path(spark, "manifest")
    flag = F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("part")
    lineitem = table(spark, sf_dir, "lineitem").select(*TRIPS.values(), flag)
    lineitem.write.partitionBy("part").option("header", True).csv(f"{path}/data")
    listed = [(f"{path}/data/part=open",), (f"{path}/data/part=closed",)]
    spark.createDataFrame(listed, "value string").write.text(f"{path}/list")
    return weekday_report(read_manifest(spark, f"{path}/list", TRIP_SCHEMA), digits=2, **TRIPS)


@query("large_manifest_weekday_report", WEEKDAYS)
def _large_manifest_weekday_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a manifest that names every file, cut into stretches of a few paths."""
    path = scratch_path(spark, "manifest")
    _trips(spark, sf_dir).repartition(40).write.option("header", True).csv(f"{path}/data")
    names = spark.read.text(f"{path}/data").select(F.col("_metadata.file_path").alias("value")).distinct()
    names.coalesce(1).write.text(f"{path}/list")
    trips = read_large_manifest(spark, f"{path}/list", TRIP_SCHEMA, stretch=1 << 10)
    return weekday_report(trips, digits=2, **TRIPS)


@query("parquet_monthly_stats", MONTHS)
def _parquet_monthly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to Parquet, statistics of what was read back, to Parquet again."""
    path = scratch_path(spark, "records")
    write_parquet(table(spark, sf_dir, "orders").select("o_orderdate", "o_custkey"), f"{path}/in")
    stats = monthly_stats(read_parquet(spark, f"{path}/in"), "o_orderdate", "o_custkey")
    write_parquet(stats, f"{path}/out")
    return read_parquet(spark, f"{path}/out")


TYPED = """
SELECT o_orderkey AS a, o_totalprice AS b, o_orderpriority AS c,
       strftime(o_orderdate, '%Y-%m-%d') AS d,
       strftime(o_orderdate + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS e
FROM orders"""


@query("versioned_overwrite", TYPED)
def _versioned_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows replace an earlier version of the table, which they are read from."""
    path = scratch_path(spark, "versioned")
    at_noon = F.expr("o_orderdate + INTERVAL 12 HOUR")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("a"),
        F.col("o_totalprice").alias("b"),
        F.upper("o_orderpriority").alias("c"),
        F.col("o_orderdate").cast("date").alias("d"),
        at_noon.cast("timestamp").alias("e"),
    )
    overwrite_versioned(rows, path)
    overwrite_versioned(read_versioned(spark, path).withColumn("c", F.upper("c")), path)
    return read_versioned(spark, path).select(
        "a",
        "b",
        "c",
        F.date_format("d", "yyyy-MM-dd").alias("d"),
        F.date_format("e", "yyyy-MM-dd HH:mm:ss").alias("e"),
    )


def _schema_name(spark: SparkSession) -> str:
    """A schema nothing else uses, with its tables in the shared folder."""
    name = f"jobs_{uuid.uuid4().hex}"
    ensure_schema(spark, name, scratch_path(spark, name))
    ensure_schema(spark, name)
    return name


@query("table_append", "SELECT p_partkey AS id, p_name AS data FROM part")
def _table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to an empty table, the second with its columns the other way round."""
    name = f"{_schema_name(spark)}.items"
    create_empty_table(spark, name, "id long, data string")
    part = table(spark, sf_dir, "part")
    small = F.col("p_size") <= 25
    cheap = part.filter(small).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("data"))
    rest = part.filter(~small).select(F.col("p_name").alias("data"), F.col("p_partkey").alias("id"))
    append_table(cheap, name)
    append_table(rest, name)
    return read_table(spark, name)


@query("table_replace", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{_schema_name(spark)}.current"
    create_or_replace_table(table(spark, sf_dir, "customer"), name)
    create_or_replace_table(table(spark, sf_dir, "supplier"), name)
    return read_table(spark, name)


def _failed_replacement(spark: SparkSession, sf_dir: str) -> str:
    """A table of orders that a replacement has died on, in the middle of its rows."""
    name = f"{_schema_name(spark)}.current"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    create_or_replace_table(orders, name)
    dies = F.when(F.col("o_orderkey") % 100 == 0, F.raise_error(F.lit("lost")).cast("string"))
    try:
        create_or_replace_table(orders.withColumn("o_orderstatus", F.coalesce(dies, F.lit("?"))), name)
    except Exception as error:
        if "lost" not in str(error):
            raise
        return name
    raise RuntimeError("the replacement was meant to fail")


@query("table_replace_failed", "SELECT o_orderkey, o_orderstatus FROM orders")
def _table_replace_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, _failed_replacement(spark, sf_dir))


@query(
    "table_replace_itself",
    """SELECT o_orderkey, o_orderstatus || '.' || o_orderkey % 7 AS o_orderstatus FROM orders
       WHERE o_orderstatus <> 'F'""",
)
def _table_replace_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice replaced from its own rows after a failure, the second time with other columns in between."""
    name = _failed_replacement(spark, sf_dir)
    rest = F.col("o_orderkey") % 7
    create_or_replace_table(read_table(spark, name).filter("o_orderstatus <> 'F'").withColumn("rest", rest), name)
    joined = F.concat("o_orderstatus", F.lit("."), F.col("rest"))
    create_or_replace_table(read_table(spark, name).select("o_orderkey", joined.alias("o_orderstatus")), name)
    return read_table(spark, name)


def _spread(factor: int, modulus: int, seed: int) -> str:
    return f"((((o_orderkey % {FOLD}) * {factor * STRETCH % FOLD} + {seed}) % {FOLD}) % {modulus})"


SEED = 42
RECORDS = f"""
SELECT o_orderkey AS id, {_spread(381_967, 1000, SEED)} + 1 AS int_field,
       {' || '.join(
           f"substr('{LETTERS}', CAST({_spread(618_033 + 12_347 * i, len(LETTERS), SEED)} + 1 AS INTEGER), 1)"
           for i in range(TEXT_LENGTH))} AS text_field,
       strftime(DATE '2021-01-01' + CAST((o_orderkey % 12) * 30 + {_spread(271_829, 30, SEED)}
                AS INTEGER), '%Y-%m-%d') AS date_field
FROM orders"""


@query("generated_records", RECORDS)
def _generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_for(table(spark, sf_dir, "orders"), "o_orderkey", SEED)


PART_CATALOG = json.dumps(
    {
        "table": {"namespace": "default", "name": "parts"},
        "rowkey": "key",
        "columns": {
            "p_partkey": {"cf": "rowkey", "col": "key", "type": "string"},
            "p_name": {"cf": "cf1", "col": "name", "type": "string"},
            "p_brand": {"cf": "cf1", "col": "brand", "type": "string"},
            "p_size": {"cf": "cf2", "col": "size", "type": "string"},
        },
    }
)
PART_SPLITS = ["2", "4", "6", "8"]


@query(
    "wide_column_cells",
    """WITH cells AS (
         SELECT CAST(p_partkey AS VARCHAR) AS rowkey, unnest(['cf1', 'cf1', 'cf2']) AS cf,
                unnest(['name', 'brand', 'size']) AS qualifier,
                unnest([p_name, p_brand, CAST(p_size AS VARCHAR)]) AS value
         FROM part)
       SELECT rowkey, cf, qualifier, value,
              CAST((rowkey >= '2')::INT + (rowkey >= '4')::INT + (rowkey >= '6')::INT
                   + (rowkey >= '8')::INT AS INTEGER) AS region
       FROM cells WHERE value IS NOT NULL""",
)
def _wide_column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "cells")
    write_wide_column(table(spark, sf_dir, "part"), PART_CATALOG, path, splits=PART_SPLITS)
    return read_wide_column(spark, path)


CUSTOMER_CATALOG = json.dumps(
    {
        "rowkey": "key",
        "columns": {
            "key": {"cf": "rowkey", "col": "key", "type": "string"},
            "c_mktsegment": {"cf": "cf1", "col": "segment", "type": "string"},
        },
    }
)


@query(
    "wide_column_regions",
    f"""SELECT CAST({' + '.join(f"(lower(c_mktsegment) >= '{s}')::INT" for s in split_keys(5))}
                    AS INTEGER) AS region, count(*) AS cells
        FROM customer GROUP BY 1""",
)
def _wide_column_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per region of a table that is divided evenly, row keys starting with a segment."""
    path = scratch_path(spark, "regions")
    key = F.lower(F.concat("c_mktsegment", "c_name")).alias("key")
    customers = table(spark, sf_dir, "customer").select(key, "c_mktsegment")
    write_wide_column(customers, CUSTOMER_CATALOG, path, regions=5)
    return read_wide_column(spark, path).groupBy("region").agg(F.count("*").alias("cells"))


ORDER_CATALOG = json.dumps(
    {
        "rowkey": "key",
        "columns": {
            "o_orderkey": {"cf": "rowkey", "col": "key", "type": "string"},
            "o_orderstatus": {"cf": "cf1", "col": "status", "type": "string"},
        },
    }
)


@query(
    "wide_column_quantiles",
    """WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus FROM orders)
       SELECT 'regions' AS what, 5::BIGINT AS n
       UNION ALL SELECT 'regions beyond twice the share', 0
       UNION ALL SELECT 'one row', count(*) FROM k WHERE key = (SELECT max(key) FROM k)
       UNION ALL SELECT 'keys from 2 to 4', count(*) FROM k WHERE key >= '2' AND key <= '4'""",
)
def _wide_column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric row keys, which an even division would put into one region."""
    path = scratch_path(spark, "quantiles")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    splits = sampled_split_keys(orders.select("o_orderkey"), 5)
    write_wide_column(orders, ORDER_CATALOG, path, splits=splits)
    per_region = read_wide_column(spark, path).groupBy("region").agg(F.count("*").alias("cells"))
    share = per_region.agg(F.count("*").alias("n"), (F.sum("cells") / 5).alias("share"))
    off = (F.col("cells") > 2 * F.col("share")) | (F.col("cells") < F.col("share") / 2)
    last = orders.agg(F.max(F.col("o_orderkey").cast("string"))).first()[0]
    counts = [
        ("regions", share.select("n")),
        ("regions beyond twice the share", per_region.crossJoin(share).agg(F.count_if(off).alias("n"))),
        ("one row", read_row(spark, path, last).agg(F.count("*").alias("n"))),
        ("keys from 2 to 4", read_wide_column(spark, path, "2", "4").agg(F.count("*").alias("n"))),
    ]
    found = [df.select(F.lit(what).alias("what"), "n") for what, df in counts]
    return found[0].union(found[1]).union(found[2]).union(found[3])
