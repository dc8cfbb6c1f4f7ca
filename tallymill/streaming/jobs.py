"""Word counts, log aggregation, phases, once-only work and table ingest as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from tallymill.operators.apps import is_terminal, latest_phase
from tallymill.operators.logs import (
    Route,
    invariant_violations,
    log_events,
    route,
    valid_events,
)
from tallymill.operators.reports import word_count
from tallymill.session import spread
from tallymill.streaming.batches import (
    MERGE_EVERY,
    Folder,
    append_batch,
    check_number,
    compact,
    read_batches,
    write_batch,
)
from tallymill.streaming.ledger import compact_ledger, known_keys


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files that arrive in a folder."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    """Start a stream; ``once`` takes what is there now and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


# --- word counts ------------------------------------------------------------

COUNTS = "word string, count long"


def stream_word_counts(
    lines: DataFrame, path: str, checkpoint: str, once: bool = True, every: int = MERGE_EVERY
) -> StreamingQuery:
    """The word counts of each batch by itself; needs no state."""

    def count(batch: DataFrame, batch_id: int) -> None:
        append_batch(word_count(batch), path, batch_id, every=every)

    return start(lines.writeStream.foreachBatch(count), checkpoint, once)


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.sum("count").alias("count"), F.max("batch").alias("batch"))


def stream_word_totals(
    lines: DataFrame, path: str, checkpoint: str, once: bool = True, every: int = MERGE_EVERY
) -> StreamingQuery:
    """Running totals: each batch adds its counts, and merged batches hold their sums.

    No state is kept between batches but what they have written.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        append_batch(word_count(batch), path, batch_id, _added_up, every)

    return start(lines.writeStream.foreachBatch(add), checkpoint, once)


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, COUNTS)


def word_totals(spark: SparkSession, path: str) -> DataFrame:
    """The current total of each word."""
    return _added_up(read_batches(spark, path, COUNTS)).drop("batch")


# --- log aggregation --------------------------------------------------------

ROUTED = (
    "cluster string, pod string, container string, timestamp timestamp, nano int, level string, "
    "logger string, thread string, message string, errors array<string>, route string"
)
ROUTED_COLUMNS = [c.split()[0] for c in ROUTED.split(", ")]


#: Parts that a part of the scan of a batch is cut into. Parsed events are kept,
#: and take some ten times as much as records in a columnar file.
LOG_PARTS = 8


def stream_logs(
    records: DataFrame,
    routes: list[Route],
    path: str,
    checkpoint: str,
    once: bool = True,
    ingest_time: Column | None = None,
    every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Raw XML records with their origin go to one folder per route.

    Valid events land under ``events``, once per route that takes them; events
    that break the invariant, valid or not, land under ``violations``. A batch of
    few files is spread over all cores, and each part of a scan over ``LOG_PARTS``
    parts. It is parsed once and kept while both are written; all routes are one
    write.
    """

    def aggregate(batch: DataFrame, batch_id: int) -> None:
        events = log_events(spread(batch, LOG_PARTS), ingest_time).persist()
        try:
            routed = route(valid_events(events), routes).select(*ROUTED_COLUMNS)
            # A route becomes few files, and a busy one is still split over tasks.
            routed = routed.hint("rebalance", "route")
            append_batch(routed, f"{path}/events", batch_id, every=every, partition_by=("route",))
            broken = invariant_violations(events).select(*ROUTED_COLUMNS[:-1])
            append_batch(broken, f"{path}/violations", batch_id, every=every)
        finally:
            events.unpersist()

    return start(records.writeStream.foreachBatch(aggregate), checkpoint, once)


def routed_events(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/events", ROUTED)


def violations(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/violations", ROUTED.rsplit(", ", 1)[0])


# --- phases -----------------------------------------------------------------


def _last_phase(key: str, order: list[str]):
    """The row of each key that counts: the last phase in ``order``."""

    def last(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != key]
        rank = F.when(F.col("phase").isNotNull(), F.struct(*order))
        # a key whose phases are all null keeps a row of nulls
        found = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("last"))
        return found.select(key, *[F.col(f"last.{c}").alias(c) for c in others])

    return last


def stream_phases(
    events: DataFrame,
    key: str,
    order: list[str],
    path: str,
    checkpoint: str,
    once: bool = True,
    every: int = MERGE_EVERY,
) -> StreamingQuery:
    """The latest phase per key as events arrive.

    A batch writes one row for each of its keys, the event that counts in
    ``order``; merged batches do the same. So no state lives between batches,
    whether or not a key has come to its end, and an event that is late, even
    behind a final phase, counts by its place in ``order`` as it does in
    :func:`latest_phase`.
    """
    last = _last_phase(key, order)
    rows = events.select(*dict.fromkeys([key, "phase", *order]))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        append_batch(last(batch), path, batch_id, last, every)

    return start(rows.writeStream.foreachBatch(upsert), checkpoint, once)


def current_phases(
    spark: SparkSession, path: str, key: str, order: list[str], schema: StructType | str
) -> DataFrame:
    return latest_phase(read_batches(spark, path, schema), key, order)


# --- once-only work ---------------------------------------------------------

_QUERY_ID = "sql.streaming.queryId"


def stream_once(
    events: DataFrame,
    key: str,
    order: list[str],
    path: str,
    checkpoint: str,
    act: Callable[[DataFrame, int], DataFrame] | None = None,
    once: bool = True,
    every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Act on the first event of each key, once in the life of the key.

    A key that the ledger holds is skipped, whichever stream has put it there.
    The ledger is written right after the action; between the two steps a failure
    repeats the batch. Its results and its ledger entries then replace those of
    the first try, so the results hold each key once. An action with effects
    elsewhere must be safe to repeat. A null key is a key like any other.

    Of the ledger only the buckets are read that the keys of the batch fall into,
    however long it has grown.
    """
    key_type = events.schema[key].dataType.simpleString()

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A checkpoint keeps the identity of its stream over restarts. A stream
        # with another checkpoint counts its batches anew, in its own folder.
        stream = spark.sparkContext.getLocalProperty(_QUERY_ID)
        results, ledger = f"{path}/results/stream={stream}", f"{path}/ledger/stream={stream}"
        check_number(Folder(spark, ledger), batch_id)
        others = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(
            F.min_by(F.struct(*others), F.struct(*order)).alias("first")
        )
        first = first.select(key, "first.*").persist()
        try:
            known = known_keys(spark, f"{path}/ledger", first.select(F.col(key).alias("key")), stream, batch_id)
            known = known.select(F.col("key").alias("_known"))
            fresh = first.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
            write_batch(act(fresh, batch_id) if act else fresh, results, batch_id)
        finally:
            first.unpersist()
        written = spark.read.parquet(f"{results}/batch={batch_id}")
        entries = written.select(F.col(key).alias("key"), F.lit("Unknown").alias("phase"))
        write_batch(entries, ledger, batch_id)
        compact(spark, results, written.schema, lambda rows: rows, batch_id, every)
        compact_ledger(spark, ledger, key_type, batch_id, every)

    return start(events.writeStream.foreachBatch(process), checkpoint, once)


def processed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The results of all streams that share a ledger."""
    return read_batches(spark, f"{path}/results", schema, streams=True).drop("stream", "batch")


# --- table ingest -----------------------------------------------------------


def stream_to_table(
    rows: DataFrame, name: str, checkpoint: str, fmt: str = "parquet", once: bool = True
) -> StreamingQuery:
    """Append a stream to a catalog table, each row exactly once.

    The source may be files or, with its connector on the class path, a topic.
    """
    writer = rows.writeStream.format(fmt).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).toTable(name)


__all__ = [
    "batch_counts",
    "current_phases",
    "is_terminal",
    "processed",
    "routed_events",
    "stream_logs",
    "stream_once",
    "stream_phases",
    "stream_to_table",
    "stream_word_counts",
    "stream_word_totals",
    "text_stream",
    "violations",
    "word_totals",
]
