"""The last runs of each key, kept bounded while runs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallymill.operators.runs import MAX_HISTORY, MIN_RUNTIME, last_n, min_duration
from tallymill.streaming.batches import MERGE_EVERY, append_batch, read_batches
from tallymill.streaming.jobs import start


def stream_history(
    runs: DataFrame,
    key: str,
    order: list[str],
    path: str,
    checkpoint: str,
    duration: str = "duration",
    least: float = MIN_RUNTIME,
    n: int = MAX_HISTORY,
    once: bool = True,
    every: int = MERGE_EVERY,
) -> StreamingQuery:
    """The last n runs of each key, short ones left out.

    The last runs of all are among the last runs of each batch, so a batch is
    cut to n runs a key when it is written, and batches are cut again when they
    are merged. What is kept follows the number of keys, not of runs, and no
    state lives between batches. A null key is a key like any other, and null
    orders come last.
    """
    columns = list(dict.fromkeys([key, *order, duration]))
    kept = min_duration(runs, least, duration).select(*columns)

    def cut(rows: DataFrame) -> DataFrame:
        return last_n(rows, key, order, n)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(cut(batch), path, batch_id, cut, every)

    return start(kept.writeStream.foreachBatch(write), checkpoint, once)


def current_history(
    spark: SparkSession,
    path: str,
    key: str,
    schema: StructType | str,
    order: list[str],
    n: int = MAX_HISTORY,
) -> DataFrame:
    """The last n runs of each key over all batches so far."""
    return last_n(read_batches(spark, path, schema).drop("batch"), key, order, n)
