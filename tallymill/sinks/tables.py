"""Catalog tables: schemas, empty tables, appends by name and replacements.

A lakehouse catalog takes the version-2 writer; the session catalog does not
support its appends and replacements, so those go through the older writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallymill.folders import Folder


def ensure_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a schema unless it is there; safe to repeat."""
    where = "" if location is None else " LOCATION '" + location.replace("'", "\\'") + "'"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{where}")


def in_session_catalog(spark: SparkSession, name: str) -> bool:
    parts = name.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    replaced = spark.conf.get("spark.sql.catalog.spark_catalog", None) not in (None, "builtin")
    return catalog == "spark_catalog" and not replaced


def create_empty_table(
    spark: SparkSession, name: str, schema: StructType | str, fmt: str = "parquet"
) -> None:
    """Create a table without rows; fails if the table exists."""
    spark.createDataFrame([], schema).writeTo(name).using(fmt).create()


def append_table(df: DataFrame, name: str) -> None:
    """Append rows, matching columns by name; the names must be the table's own."""
    spark = df.sparkSession
    if not in_session_catalog(spark, name):
        df.writeTo(name).append()
        return
    columns = spark.table(name).columns
    if sorted(columns) != sorted(df.columns):
        raise ValueError(f"columns {df.columns} do not match {columns} of {name}")
    df.select(*columns).write.insertInto(name)


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """The folder of a table's schema, and the table's name in it."""
    *schema, table = name.split(".")
    schema = schema[-1] if schema else spark.catalog.currentDatabase()
    return spark.catalog.getDatabase(schema).locationUri.rstrip("/"), table


def _facts(spark: SparkSession, name: str) -> dict[str, str]:
    """Location, provider and the like of a table of the session catalog."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    return {r.col_name: r.data_type for r in rows if r.col_name}


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def _aside(name: str) -> str:
    return f"{name}__replaced"


def restore_table(spark: SparkSession, name: str) -> bool:
    """Give a table its name back that a replacement has died on, and say whether that was so."""
    if spark.catalog.tableExists(name) or not spark.catalog.tableExists(_aside(name)):
        return False
    spark.sql(f"ALTER TABLE {_aside(name)} RENAME TO {name}")
    return True


def _switch(spark: SparkSession, df: DataFrame, name: str, fmt: str, path: str) -> None:
    """Let a table of the session catalog be what lies at ``path``.

    A table that keeps its columns only gets another location, which is a single
    step. The session catalog has no such step for other columns: the old table
    is kept under another name until the new one is there.
    """
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source=fmt, schema=df.schema)
        return
    old, facts = spark.table(name), _facts(spark, name)
    plain = "# Partition Information" not in facts and facts.get("Num Buckets") is None
    if plain and _columns(old) == _columns(df) and facts.get("Provider", "").lower() == fmt.lower():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        return
    spark.sql(f"DROP TABLE IF EXISTS {_aside(name)}")
    spark.sql(f"ALTER TABLE {name} RENAME TO {_aside(name)}")
    try:
        spark.catalog.createTable(name, path=path, source=fmt, schema=df.schema)
    except BaseException:
        restore_table(spark, name)
        raise
    spark.sql(f"DROP TABLE {_aside(name)}")


def create_or_replace_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Put the rows in place of whatever the table held.

    A lakehouse catalog does this by itself. In the session catalog the rows go
    to a new folder first, and only then the table is pointed at it; so a
    replacement that fails leaves the old rows, and a table may be replaced from
    itself. The folder before stays for those who are reading it until the next
    replacement. Only one replacement of a table may run at a time.
    """
    spark = df.sparkSession
    if not in_session_catalog(spark, name):
        df.writeTo(name).using(fmt).createOrReplace()
        return
    restore_table(spark, name)
    schema_folder, table = _folders(spark, name)
    folder, version = Folder(spark, schema_folder), uuid.uuid4().hex
    versions = f"{table}.versions"
    path = f"{schema_folder}/{versions}/{version}"
    before = _facts(spark, name).get("Location", "") if spark.catalog.tableExists(name) else ""
    try:
        df.write.format(fmt).save(path)
        _switch(spark, df, name, fmt, path)
    except BaseException:
        folder.remove(f"{versions}/{version}")
        raise
    for old in folder.names(versions):
        if old != version and not before.endswith(f"/{old}"):
            folder.remove(f"{versions}/{old}")
