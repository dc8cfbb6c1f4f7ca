"""Application phases, once-only work, event logs and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.apps import (
    PHASES,
    attach_status,
    expired_applications,
    latest_phase,
    list_applications,
    not_yet_processed,
    orphans,
)
from tallymill.plans.registry import query, table
from tallymill.plans.rendered import application_lines, epoch_micros
from tallymill.session import scratch_path
from tallymill.sources.logs import parse_event_log, read_event_log

PHASE = (
    "CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' "
    "ELSE 'Running' END"
)
CURRENT = f"""
SELECT user_id, arg_max({PHASE}, (ts, event_id)) AS phase,
       arg_max({PHASE}, (ts, event_id)) IN ('Succeeded', 'Failed') AS terminal
FROM events GROUP BY user_id"""
NUMBERED = CURRENT.replace("(ts, event_id)", "event_id")


def phase_events(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "ts", F.expr(PHASE).alias("phase"))


@query("latest_phase", NUMBERED)
def _latest_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events are numbered in their order, so the number alone decides."""
    events = phase_events(table(spark, sf_dir, "events"))
    return latest_phase(events, "user_id", "event_id", phases=PHASES)


@query("latest_phase_by_time", CURRENT)
def _latest_phase_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by time, and by number where the time is the same."""
    events = phase_events(table(spark, sf_dir, "events"))
    return latest_phase(events, "user_id", ["ts", "event_id"])


@query(
    "not_yet_processed",
    """SELECT event_id, user_id FROM events WHERE user_id NOT IN (
         SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def _not_yet_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for keys with a history; some have no phase yet."""
    ledger = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        F.when(F.col("s_acctbal") > 0, "Unknown").otherwise("").alias("phase"),
    )
    batch = table(spark, sf_dir, "events").select("event_id", "user_id")
    return not_yet_processed(batch, ledger, "user_id")


def _driver_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("ns-"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        F.col("user_id").alias("app"),
        "event_id",
        F.expr(PHASE).alias("phase"),
    )
    apps = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ns-"), (F.col("s_suppkey") % 3).cast("string")).alias("namespace"),
        F.col("s_suppkey").alias("app"),
        F.col("s_name").alias("resolved_refs"),
    )
    return events, apps


@query(
    "status_of_driver_events",
    f"""SELECT 'ns-' || (user_id % 3) AS namespace, user_id AS app, event_id, {PHASE} AS phase,
               s_name AS resolved_refs
        FROM events JOIN supplier ON user_id = s_suppkey""",
)
def _status_of_driver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_status(*_driver_events(spark, sf_dir), ["namespace", "app"])


@query(
    "driver_events_without_application",
    f"""SELECT 'ns-' || (user_id % 3) AS namespace, user_id AS app, event_id, {PHASE} AS phase
        FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _driver_events_without_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(*_driver_events(spark, sf_dir), ["namespace", "app"])


APPLICATIONS = """
SELECT 'app-' || user_id AS log, 'app-' || user_id AS app_id, 'shop ' || user_id AS app_name,
       'u' || (user_id % 5) AS "user", min(epoch_us(ts)) // 1000 AS start_ms,
       CASE WHEN count(*) % 2 = 0 THEN max(epoch_us(ts)) // 1000 END AS end_ms,
       CASE WHEN count(*) % 2 = 0
            THEN max(epoch_us(ts)) // 1000 - min(epoch_us(ts)) // 1000 END AS duration_ms,
       count(*) % 2 = 0 AS completed
FROM events GROUP BY user_id"""


@query("applications", APPLICATIONS)
def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_applications(parse_event_log(application_lines(spark, sf_dir)))


MAX_AGE_MS = 6 * 3600 * 1000
NOW = "2024-01-30 23:00:00"


@query(
    "expired_applications",
    f"""SELECT log, start_ms, end_ms, completed FROM ({APPLICATIONS}) JOIN (
          SELECT 'app-' || user_id AS log, max(ts) AS modified FROM events GROUP BY user_id)
        USING (log) WHERE modified < TIMESTAMP '{NOW}' - INTERVAL {MAX_AGE_MS} MILLISECOND""",
)
def _expired_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_event_log(application_lines(spark, sf_dir))
    expired = expired_applications(logs, MAX_AGE_MS, F.lit(NOW).cast("timestamp"))
    return expired.select("log", "start_ms", "end_ms", "completed")


@query(
    "event_log_files",
    """SELECT event_type || '-' || strftime(ts, '%Y-%m-%d') AS log, min(epoch_us(ts)) // 1000 AS start_ms,
              max(epoch_us(ts)) // 1000 AS end_ms, count(*) + 2 AS lines
       FROM events GROUP BY 1""",
)
def _event_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log folders, one per kind of event and day, and what is read from them."""
    path = scratch_path(spark, "logs")
    day = F.date_format("ts", "yyyy-MM-dd")
    timed = table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("-"), day).alias("app"),
        "event_id",
        F.floor(epoch_micros("ts") / 1000).cast("long").alias("ms"),
    )
    start = F.format_string(
        '{"Event":"SparkListenerApplicationStart","App Name":"%s","App ID":"%s","Timestamp":%d,'
        '"User":"u"}',
        "app",
        "app",
        F.min("ms"),
    )
    end = F.format_string('{"Event":"SparkListenerApplicationEnd","Timestamp":%d}', F.max("ms"))
    framing = timed.groupBy("app").agg(F.array(start, end).alias("values"))
    job = F.format_string('{"Event":"SparkListenerJobStart","Job ID":%d}', "event_id")
    lines = framing.select("app", F.explode("values").alias("value")).unionByName(
        timed.select("app", job.alias("value"))
    )
    folder = F.concat(F.lit("eventlog_v2_"), F.col("app")).alias("log")
    lines.select(folder, "value").hint("rebalance", "log").write.partitionBy("log").text(path)
    logs = read_event_log(spark, path)
    counted = logs.groupBy("log").agg(F.count("*").alias("lines"))
    apps = list_applications(logs).select("log", "start_ms", "end_ms")
    return apps.join(counted, "log")
