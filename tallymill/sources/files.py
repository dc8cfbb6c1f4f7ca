"""Plain readers: CSV, Parquet, manifests and catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

def read_csv(
    spark: SparkSession,
    path: str | list[str],
    header: bool = True,
    infer: bool = True,
    schema: StructType | str | None = None,
) -> DataFrame:
    """CSV files from any path Spark can read.

    Inferring types reads the files one extra time; pass a schema for large input.
    """
    reader = spark.read.option("header", header)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the default catalog."""
    return spark.read.table(name)


def manifest_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths listed in a text file, one a line."""
    lines = spark.read.text(path).filter("trim(value) <> ''").collect()
    return [line.value.strip() for line in lines]


def read_manifest(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """The CSV files whose paths a text file lists, as one table."""
    return read_csv(spark, manifest_paths(spark, path), schema=schema)
