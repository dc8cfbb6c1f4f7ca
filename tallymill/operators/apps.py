"""Application histories: phases, once-only work, event logs, metrics, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import broadcast_if_small
from tallymill.sources.logs import APPLICATION_END, APPLICATION_EVENT, APPLICATION_START

# The phases of a pod and those it does not leave again.
UNKNOWN = "Unknown"
PHASES = ["Pending", "Running", "Succeeded", "Failed", UNKNOWN]
TERMINAL = ["Succeeded", "Failed"]


def is_terminal(phase: Column) -> Column:
    return phase.isin(TERMINAL)


def latest_phase(
    events: DataFrame,
    key: str | list[str] = "app",
    order: str | list[str] = "ts",
    phase: str = "phase",
    phases: list[str] | None = None,
) -> DataFrame:
    """The current phase of each key and whether it is final.

    The last event in ``order`` counts; a key without any phase is ``Unknown``.
    Only the last event of a key leaves a task, so a busy key costs one row each.

    With the complete list of ``phases``, a phase is held as its number. If the
    order is one number or timestamp too, the aggregation hashes, without the
    sort that text and several order columns need. A phase not listed is an error.
    """
    keys = [key] if isinstance(key, str) else key
    columns = [order] if isinstance(order, str) else order
    rank = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    rank = F.when(F.col(phase).isNotNull(), rank)
    if phases is None:
        last = F.max_by(phase, rank)
    else:
        other = F.raise_error(F.concat(F.lit("unknown phase "), F.col(phase))).cast("int")
        number = reduce(
            lambda c, p: c.when(F.col(phase) == p[1], p[0]),
            enumerate(phases),
            F.when(F.col(phase).isNull(), None),
        ).otherwise(other)
        names = F.array(*map(F.lit, phases))
        last = F.get(names, F.max_by(number, rank))
    return (
        events.groupBy(*keys)
        .agg(F.coalesce(last, F.lit(UNKNOWN)).alias("phase"))
        .withColumn("terminal", is_terminal(F.col("phase")))
    )


def not_yet_processed(batch: DataFrame, ledger: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows of a batch whose key has no phase in the ledger.

    The ledger is reduced to its keys first, so a key with many entries is one.
    """
    keys = [key] if isinstance(key, str) else key
    done = ledger.filter(F.coalesce("phase", F.lit("")) != "").select(*keys).distinct()
    return batch.join(done, keys, "left_anti")


def attach_status(events: DataFrame, apps: DataFrame, on: list[str]) -> DataFrame:
    """Driver events with the columns of their application.

    ``apps`` has one row per key. Events of an unknown application are left out
    here; :func:`orphans` reports them. A small table of applications is
    broadcast. With a large one the events are shuffled, and adaptive execution
    splits an application that has very many.
    """
    return events.join(broadcast_if_small(apps), on, "inner")


def orphans(events: DataFrame, apps: DataFrame, on: list[str]) -> DataFrame:
    """Driver events whose application does not exist."""
    return events.join(broadcast_if_small(apps.select(*on)), on, "left_anti")


def _applications(event_log: DataFrame, *others: Column) -> DataFrame:
    """One row per log that has a start line, with more aggregates over its lines."""
    start = F.col("event") == APPLICATION_START
    end = F.col("event") == APPLICATION_END
    return (
        event_log.groupBy("log")
        .agg(
            F.max(F.when(start, F.col("app_id"))).alias("app_id"),
            F.max(F.when(start, F.col("app_name"))).alias("app_name"),
            F.max(F.when(start, F.col("user"))).alias("user"),
            F.max(F.when(start, F.col("ts_ms"))).alias("start_ms"),
            F.max(F.when(end, F.col("ts_ms"))).alias("end_ms"),
            *others,
        )
        .filter("start_ms IS NOT NULL")
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .withColumn("completed", F.col("end_ms").isNotNull())
    )


def list_applications(event_log: DataFrame) -> DataFrame:
    """One row per application that has started.

    Only the start and end lines are looked at, and a plain search of the text
    finds almost no others. The end line does not name the application, so the
    log a line belongs to is the key.
    """
    framing = F.col("event").isin(APPLICATION_START, APPLICATION_END)
    return _applications(event_log.filter(F.col("value").contains(APPLICATION_EVENT)).filter(framing))


def expired_applications(event_log: DataFrame, max_age_ms: int, now: Column) -> DataFrame:
    """The logs a cleaner would remove: not written to for longer than ``max_age_ms``.

    This lists them and deletes nothing. The lines are read once, as the time of
    a file comes with each of them.
    """
    limit = now - F.make_dt_interval(secs=F.lit(max_age_ms) / F.lit(1000))
    found = _applications(event_log, F.max("modified").alias("modified"))
    return found.filter(F.col("modified") < limit)


def metric_present(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected metrics that no sample shows: columns ``endpoint`` and ``metric``.

    A sample shows a metric if its name contains it. The samples are reduced to
    the distinct names of each endpoint first, so the comparison does not grow
    with the number of scrapes.
    """
    wanted = broadcast_if_small(expected.select("endpoint", "metric"))
    found = (
        samples.select("endpoint", "name")
        .distinct()
        .join(wanted, "endpoint")
        .filter(F.col("name").contains(F.col("metric")))
        .select("endpoint", "metric")
        .distinct()
    )
    return expected.select("endpoint", "metric").join(found, ["endpoint", "metric"], "left_anti")
