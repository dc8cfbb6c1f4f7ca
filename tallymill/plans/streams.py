"""Streams that take the provided tables as files, run to their end and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.plans.histories import CURRENT, phase_events
from tallymill.plans.logging import ROUTES_ON, ingested
from tallymill.plans.registry import query, table
from tallymill.plans.rendered import RECORDS_CTE, render_records, routes, routes_values
from tallymill.plans.reporting import WORDS
from tallymill.plans.running import HISTORY
from tallymill.session import input_bytes, scratch_path
from tallymill.sinks.tables import ensure_schema
from tallymill.sources.files import read_table
from tallymill.streaming.history import current_history, stream_history
from tallymill.streaming.jobs import (
    batch_counts,
    current_phases,
    processed,
    routed_events,
    stream_logs,
    stream_once,
    stream_phases,
    stream_to_table,
    stream_word_counts,
    stream_word_totals,
    text_stream,
    violations,
    word_totals,
)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern takes a table in one file as well as one in a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events.parquet}}")


def _lines(spark: SparkSession, sf_dir: str, path: str, batches: int = 1) -> DataFrame:
    """The documents as text files, and the stream of their lines."""
    texts = table(spark, sf_dir, "documents").select("text")
    if batches == 1:
        texts.write.text(f"{path}/text")
        return text_stream(spark, f"{path}/text")
    files = _files(texts, batches)
    texts.repartition(files * batches).write.text(f"{path}/text")
    return text_stream(spark, f"{path}/text", files)


#: Bytes of a table that become one file of a stream.
FILE_BYTES = 16 << 20


def _files(rows: DataFrame, batches: int) -> int:
    """Files of a batch: one for each core, and more for a larger table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(2, cores, -(-input_bytes(rows) // (FILE_BYTES * batches)))


def _in_batches(rows: DataFrame, path: str, batches: int) -> DataFrame:
    """The rows as a stream of so many batches."""
    files = _files(rows, batches)
    rows.repartition(files * batches).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_word_counts", WORDS)
def _stream_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per batch; added up, they are the counts of all lines."""
    path = scratch_path(spark, "words")
    lines = _lines(spark, sf_dir, path)
    stream_word_counts(lines, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    counts = batch_counts(spark, f"{path}/out")
    return counts.groupBy("word").agg(F.sum("count").alias("count"))


@query("stream_word_totals", WORDS)
def _stream_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches; two at a time are merged."""
    path = scratch_path(spark, "totals")
    lines = _lines(spark, sf_dir, path, 5)
    stream_word_totals(lines, f"{path}/out", f"{path}/checkpoint", every=2).awaitTermination()
    return word_totals(spark, f"{path}/out")


@query(
    "stream_log_routes",
    f"""WITH {RECORDS_CTE},
        routed AS (SELECT route FROM records JOIN {routes_values()} {ROUTES_ON}
                   WHERE c IN (0, 1, 13))
        SELECT route, count(*) AS events FROM routed GROUP BY route""",
)
def _stream_log_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "logs")
    records = render_records(event_stream(spark, sf_dir)).drop("event_id")
    stream_logs(
        records, routes(), f"{path}/out", f"{path}/checkpoint", ingest_time=ingested()
    ).awaitTermination()
    kept = routed_events(spark, f"{path}/out").select("route")
    broken = violations(spark, f"{path}/out").select(F.lit("violation").alias("route"))
    return kept.unionByName(broken).groupBy("route").agg(F.count("*").alias("events"))


@query(
    "stream_log_events",
    f"""WITH {RECORDS_CTE}
        SELECT route, 'event ' || event_id || ' ' || props AS message, lvl AS level,
               'shop.' || event_type AS logger
        FROM records JOIN {routes_values()} {ROUTES_ON} WHERE c IN (0, 1, 13)""",
)
def _stream_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lands under each route, over four batches of which some are merged."""
    path = scratch_path(spark, "logs")
    records = render_records(table(spark, sf_dir, "events")).drop("event_id")
    stream_logs(
        _in_batches(records, f"{path}/records", 4), routes(), f"{path}/out", f"{path}/checkpoint",
        ingest_time=ingested(), every=2,
    ).awaitTermination()
    return routed_events(spark, f"{path}/out").select("route", "message", "level", "logger")


@query("stream_phases", CURRENT)
def _stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches with the events of a key in any order; two at a time are merged."""
    path = scratch_path(spark, "phases")
    order = ["ts", "event_id"]
    events = _in_batches(phase_events(table(spark, sf_dir, "events")), f"{path}/events", 5)
    stream_phases(
        events, "user_id", order, f"{path}/out", f"{path}/checkpoint", every=2
    ).awaitTermination()
    ts_type = events.schema["ts"].dataType.simpleString()
    schema = f"user_id long, phase string, ts {ts_type}, event_id long"
    return current_phases(spark, f"{path}/out", "user_id", order, schema)


@query(
    "stream_once",
    """SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type
       FROM events GROUP BY user_id""",
)
def _stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over five batches, more input and a restart, and a second stream.

    The first events come with the first five batches, so what the restarted
    stream and the second one read is in the ledger, merged or not.
    """
    path = scratch_path(spark, "once")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    firsts = events.groupBy("user_id").agg(F.min("event_id").alias("first"))
    events = events.join(firsts, "user_id")
    for later, checkpoint in ((False, "first"), (True, "first"), (None, "second")):
        rows = events.where((F.col("event_id") != F.col("first")) if later else (F.col("event_id") == F.col("first")))
        rows = rows.drop("first")
        if later is None:
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        else:
            stream = _in_batches(rows, f"{path}/in", 1 if later else 5)
        stream_once(
            stream, "user_id", ["event_id"], f"{path}/out", f"{path}/{checkpoint}", every=2
        ).awaitTermination()
    return processed(spark, f"{path}/out", rows.schema)


@query("stream_history", HISTORY)
def _stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches, each of which changes keys of the one before; two at a time are merged."""
    path = scratch_path(spark, "history")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    runs = _in_batches(events, f"{path}/events", 5).select(
        F.col("user_id").alias("test_name"), "event_id", F.col("value").alias("duration")
    )
    order = ["event_id"]
    stream_history(
        runs, "test_name", order, f"{path}/out", f"{path}/checkpoint", every=2
    ).awaitTermination()
    schema = "test_name long, event_id long, duration double"
    return current_history(spark, f"{path}/out", "test_name", schema, order)


@query("stream_to_table", "SELECT event_id, user_id, event_type, value FROM events")
def _stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ingest")
    schema = f"jobs_{uuid.uuid4().hex}"
    ensure_schema(spark, schema, f"{path}/{schema}")
    rows = event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    stream_to_table(rows, f"{schema}.events", f"{path}/checkpoint").awaitTermination()
    return read_table(spark, f"{schema}.events")
