"""Log parsing, validation, filtering, routing and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.text import log_timestamp, millis_timestamp
from tallymill.operators.apps import metric_present
from tallymill.operators.logs import (
    BAD_LEVEL,
    BAD_MILLIS,
    BAD_SECOND,
    LEVELS,
    NO_LEVEL,
    NO_LOGGER,
    NO_MESSAGE,
    NO_NANO,
    NO_SECOND,
    NO_TIME,
    UNPARSABLE,
    WRONG_TAG,
    count_per_route,
    invariant_violations,
    level_filter,
    log_events,
    parse_log_events,
    route,
    silent_routes,
    valid_events,
)
from tallymill.plans.registry import query, table
from tallymill.plans.rendered import (
    LEVEL,
    RECORDS_CTE,
    epoch_micros,
    log_records,
    routes,
    routes_values,
)
from tallymill.session import scratch_path
from tallymill.sources.logs import (
    RECORD_SEPARATOR,
    parse_prometheus,
    read_log4j_xml,
    read_pattern_log,
    read_prometheus,
)

#: Time of ingestion in all queries: 2024-02-01 00:00 UTC in seconds.
INGESTED = 1_706_745_600


def ingested() -> Column:
    return F.timestamp_seconds(F.lit(INGESTED))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(log_records(spark, sf_dir), ingested())


# --- parsing ----------------------------------------------------------------


@query("log_records", f"WITH {RECORDS_CTE} SELECT raw FROM records")
def _log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a log file and cut apart again."""
    path = scratch_path(spark, "xml")
    log_records(spark, sf_dir).select("raw").write.option("lineSep", RECORD_SEPARATOR).text(path)
    return read_log4j_xml(spark, path)


@query(
    "parsed_log_events",
    f"""WITH {RECORDS_CTE}
        SELECT event_id, c = 12 AS corrupt,
          CASE WHEN c = 11 THEN 'NoEvent' ELSE 'Event' END AS root_tag,
          CASE WHEN c IN (5, 12) THEN NULL WHEN c = 6 THEN '10000000000000000'
               ELSE CAST(millis AS VARCHAR) END AS millis,
          CASE WHEN c IN (1, 2, 5, 6, 12) THEN NULL WHEN c = 4 THEN '10000000000000'
               ELSE CAST(sec AS VARCHAR) END AS epoch_second,
          CASE WHEN c IN (1, 3, 5, 6, 12) THEN NULL WHEN c = 4 THEN '0'
               ELSE CAST(nano AS VARCHAR) END AS nano_of_second,
          CASE WHEN c IN (8, 12) THEN NULL WHEN c = 9 THEN 'CRITICAL' ELSE lvl END AS level,
          CASE WHEN c NOT IN (7, 12) THEN 'shop.' || event_type END AS logger,
          CASE WHEN c <> 12 THEN 'user-' || user_id END AS thread,
          CASE WHEN c NOT IN (10, 12) THEN 'event ' || event_id || ' ' || props END AS message,
          CASE WHEN c <> 12 AND event_type = 'error' THEN 'ShopError' END AS thrown,
          CASE WHEN c <> 12 AND event_type = 'error' THEN 'sell,run' END AS methods
        FROM records""",
)
def _parsed_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event")
    frames = e["Thrown"]["ExtendedStackTrace"]["ExtendedStackTraceItem"]
    return parse_log_events(log_records(spark, sf_dir)).select(
        "event_id",
        e["_corrupt_record"].isNotNull().alias("corrupt"),
        "root_tag",
        e["_timeMillis"].alias("millis"),
        e["Instant"]["_epochSecond"].alias("epoch_second"),
        e["Instant"]["_nanoOfSecond"].alias("nano_of_second"),
        e["_level"].alias("level"),
        e["_loggerName"].alias("logger"),
        e["_thread"].alias("thread"),
        e["Message"].alias("message"),
        e["Thrown"]["_name"].alias("thrown"),
        F.array_join(F.transform(frames, lambda f: f["_method"]), ",").alias("methods"),
    )


REASON = f"""
CASE c WHEN 2 THEN '{NO_SECOND}' WHEN 3 THEN '{NO_NANO}' WHEN 4 THEN '{BAD_SECOND}'
       WHEN 5 THEN '{NO_TIME}' WHEN 6 THEN '{BAD_MILLIS}' WHEN 7 THEN '{NO_LOGGER}'
       WHEN 8 THEN '{NO_LEVEL}' WHEN 9 THEN '{BAD_LEVEL}' WHEN 10 THEN '{NO_MESSAGE}'
       WHEN 11 THEN '{WRONG_TAG}' WHEN 12 THEN '{UNPARSABLE}' END"""


@query(
    "log_errors",
    f"WITH {RECORDS_CTE} SELECT event_id, {REASON} AS errors FROM records",
)
def _log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).select("event_id", F.array_join("errors", ",").alias("errors"))


FILLED = f"""
SELECT event_id,
  CASE WHEN c IN (2, 3, 4, 5, 6, 12) THEN {INGESTED * 1_000_000}
       WHEN c = 1 THEN millis * 1000 ELSE epoch_us(ts) END AS micros,
  CASE WHEN c IN (8, 9, 12) THEN 'INFO' ELSE lvl END AS level,
  CASE WHEN c IN (7, 12) THEN '' ELSE 'shop.' || event_type END AS logger,
  CASE WHEN c IN (10, 12) THEN raw ELSE 'event ' || event_id || ' ' || props END AS message
FROM records"""


def flat(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.unix_micros("timestamp").alias("micros"), "level", "logger", "message"
    )


@query("filled_log_events", f"WITH {RECORDS_CTE} {FILLED}")
def _filled_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(events_of(spark, sf_dir))


@query("valid_events_of_a_file", f"WITH {RECORDS_CTE} {FILLED} WHERE c IN (0, 1, 13)")
def _valid_events_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a file, where every unparsable one has a good one behind it."""
    path = scratch_path(spark, "xml")
    records = log_records(spark, sf_dir)
    (
        records.repartitionByRange("event_id")
        .sortWithinPartitions("event_id")
        .select("raw")
        .write.option("lineSep", RECORD_SEPARATOR)
        .text(path)
    )
    number = F.regexp_extract("message", r"^event (\d+) ", 1).try_cast("long")
    events = valid_events(log_events(read_log4j_xml(spark, path), ingested()))
    return flat(events.withColumn("event_id", number))


@query("valid_log_events", f"WITH {RECORDS_CTE} {FILLED} WHERE c IN (0, 1, 13)")
def _valid_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(valid_events(events_of(spark, sf_dir)))


@query("log_invariant", f"WITH {RECORDS_CTE} {FILLED} WHERE false")
def _log_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filling keeps the invariant on every event, so nothing is left."""
    return flat(invariant_violations(events_of(spark, sf_dir)))


@query(
    "log_invariant_before_filling",
    f"WITH {RECORDS_CTE} SELECT event_id FROM records WHERE c IN (5, 6, 7, 8, 10, 12)",
)
def _log_invariant_before_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check on events that were parsed only; no time counts as the epoch."""
    e = F.col("event")
    epoch = F.timestamp_seconds(F.lit(0))
    bare = parse_log_events(log_records(spark, sf_dir)).select(
        "event_id",
        F.coalesce(millis_timestamp(e["_timeMillis"]), epoch).alias("timestamp"),
        e["_level"].alias("level"),
        e["_loggerName"].alias("logger"),
        e["Message"].alias("message"),
    )
    return invariant_violations(bare).select("event_id")


@query(
    "log_timestamps",
    f"""WITH {RECORDS_CTE}
        SELECT event_id, CASE WHEN c IN (2, 3, 4, 5, 6) THEN NULL
                              WHEN c = 1 THEN millis * 1000 ELSE epoch_us(ts) END AS micros
        FROM records""",
)
def _log_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time rule on plain columns, without any parsing."""
    c = F.col("event_id") % 14
    micros = epoch_micros("ts")
    second = F.floor(micros / 1_000_000).cast("long")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        (~c.isin(1, 5, 6)).alias("has_instant"),
        F.when(c == 4, "10000000000000").when(c != 2, second.cast("string")).alias("second"),
        F.when(c != 3, (micros % 1_000_000 * 1000).cast("string")).alias("nano"),
        F.when(c == 6, "10000000000000000")
        .when(c != 5, F.floor(micros / 1000).cast("long").cast("string"))
        .alias("millis"),
    )
    time = log_timestamp(F.col("has_instant"), F.col("second"), F.col("nano"), F.col("millis"))
    return events.select("event_id", F.unix_micros(time).alias("micros"))


# --- routing ----------------------------------------------------------------

ROUTES_ON = """
  ON container = r_container AND (r_pod IS NULL OR pod = r_pod)
  AND (r_cluster IS NULL OR cluster = r_cluster)
  AND (r_suffix IS NULL OR ends_with(pod, r_suffix))"""


@query(
    "routed_log_events",
    f"""WITH {RECORDS_CTE}
        SELECT route, event_id FROM records JOIN {routes_values()} {ROUTES_ON}
        WHERE c IN (0, 1, 13)""",
)
def _routed_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_events(events_of(spark, sf_dir))
    return route(valid, routes()).select("route", "event_id")


@query(
    "events_per_route",
    f"""WITH {RECORDS_CTE}
        SELECT route, count(event_id) AS events
        FROM (SELECT * FROM records WHERE c IN (0, 1, 13)) RIGHT JOIN {routes_values()}
        {ROUTES_ON} GROUP BY route""",
)
def _events_per_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_per_route(valid_events(events_of(spark, sf_dir)), routes())


@query(
    "silent_routes",
    f"""WITH {RECORDS_CTE}
        SELECT route FROM {routes_values()} WHERE route NOT IN (
          SELECT route FROM records JOIN {routes_values()} {ROUTES_ON} WHERE c IN (0, 1, 13))""",
)
def _silent_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silent_routes(valid_events(events_of(spark, sf_dir)), routes())


# --- levels -----------------------------------------------------------------

THRESHOLDS = {
    "ROOT": "INFO",
    "shop.click": "DEBUG",
    "shop.view": "OFF",
    "shop.purchase": "ERROR",
    "shop.purchase.u3": "ALL",
}
LOGGER = "'shop.' || event_type || '.u' || CAST(user_id % 10 AS STRING)"


@query(
    "events_above_level",
    f"""WITH e AS (SELECT event_id, {LEVEL} AS level, {LOGGER} AS logger FROM events),
        ranks(name, n) AS (VALUES ('ALL', -1), {', '.join(f"('{x}', {i})" for i, x in enumerate(LEVELS))},
                           ('OFF', {len(LEVELS)})),
        t(prefix, least) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in THRESHOLDS.items())}),
        best AS (
          SELECT event_id, level, logger, arg_max(least, length(prefix)
                 * (prefix <> 'ROOT')::INT) AS least
          FROM e JOIN t ON prefix = 'ROOT' OR logger = prefix OR starts_with(logger, prefix || '.')
          GROUP BY ALL)
        SELECT event_id, best.level, logger FROM best
        JOIN ranks a ON a.name = best.level JOIN ranks b ON b.name = best.least
        WHERE a.n >= b.n""",
)
def _events_above_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", F.expr(LEVEL).alias("level"), F.expr(LOGGER).alias("logger")
    )
    return level_filter(events, THRESHOLDS)


# --- pattern logs and metrics -----------------------------------------------


@query(
    "pattern_log",
    f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0')
               AS clock, {LEVEL} AS level, 'user-' || user_id AS thread,
               'shop.' || event_type AS logger, 'event ' || event_id || ' ' || props AS message
        FROM events""",
)
def _pattern_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pattern")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSS"),
        F.lit(" "),
        F.expr(LEVEL),
        F.expr("' [user-' || user_id || '] shop.' || event_type || ' - '"),
        F.expr("'event ' || event_id || ' ' || props"),
    )
    table(spark, sf_dir, "events").select(line).write.text(path)
    clock = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("clock")
    return read_pattern_log(spark, path).select(clock, "level", "thread", "logger", "message")


TRACE = ["java.lang.IllegalStateException: no stock", "\tat Shop.sell(Shop.java:12)", "\tat Shop.run(Shop.java:34)"]


@query(
    "pattern_log_traces",
    f"""SELECT event_id, {LEVEL} AS level, 'event ' || event_id
               || CASE WHEN event_type = 'error' THEN {' || '.join(f"chr(10) || '{line}'" for line in TRACE)}
                       ELSE '' END AS message
        FROM events""".replace("\t", "' || chr(9) || '"),
)
def _pattern_log_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error is followed by the lines of a stack trace."""
    path = scratch_path(spark, "traces")
    head = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSS"),
        F.lit(" "),
        F.expr(LEVEL),
        F.expr("' [user-' || user_id || '] shop.' || event_type || ' - event ' || event_id"),
    )
    trace = F.lit("".join(f"\n{line}" for line in TRACE))
    line = F.when(F.col("event_type") == "error", F.concat(head, trace)).otherwise(head)
    table(spark, sf_dir, "events").select(line).write.text(path)
    events = read_pattern_log(spark, path)
    event_id = F.regexp_extract("message", r"^event (\d+)", 1).cast("long").alias("event_id")
    return events.select(event_id, "level", "message")


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scrape with a comment above each sample."""
    lines = F.array(
        F.expr("'# TYPE metrics_' || event_type || ' gauge'"),
        F.expr(
            "'metrics_' || event_type || '_' || (user_id % 7) || '_Value{type=\"gauges\", id=\"'"
            " || event_id || '\"} ' || value"
        ),
        F.lit(""),
    )
    endpoint = F.expr("'shop-' || event_type").alias("endpoint")
    return table(spark, sf_dir, "events").select(endpoint, F.explode(lines).alias("value"))


@query(
    "metric_samples",
    """SELECT 'metrics_' || event_type || '_' || (user_id % 7) || '_Value' AS name,
              'gauges' AS type, CAST(event_id AS VARCHAR) AS id, value
       FROM events""",
)
def _metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    metric_lines(spark, sf_dir).select("value").write.text(path)
    return read_prometheus(spark, path).select(
        "name", F.col("labels")["type"].alias("type"), F.col("labels")["id"].alias("id"), "value"
    )


KIND = "CASE n_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END"


@query(
    "missing_metrics",
    f"""WITH expected AS (
          SELECT 'shop-' || {KIND} AS endpoint, {KIND} || '_' || (n_nationkey % 10) || '_' AS metric
          FROM nation),
        samples AS (
          SELECT DISTINCT 'shop-' || event_type AS endpoint,
                 'metrics_' || event_type || '_' || (user_id % 7) || '_Value' AS name FROM events)
        SELECT * FROM expected e WHERE NOT EXISTS (
          SELECT 1 FROM samples s WHERE s.endpoint = e.endpoint AND contains(s.name, e.metric))""",
)
def _missing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "nation").select(
        F.expr(f"'shop-' || {KIND}").alias("endpoint"),
        F.expr(f"{KIND} || '_' || (n_nationkey % 10) || '_'").alias("metric"),
    )
    return metric_present(parse_prometheus(metric_lines(spark, sf_dir)), expected)
