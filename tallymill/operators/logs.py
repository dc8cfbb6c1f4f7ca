"""Parsing, validating, filtering and routing of log events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.text import (
    MAX_SECOND,
    MIN_SECOND,
    in_range,
    log_timestamp,
)
from tallymill.session import BROADCAST_ROWS, broadcast_if_small
from tallymill.sources.logs import LOG_EVENT

# Levels of a log event from the least to the most severe.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]

# --- parsing and validation -------------------------------------------------

UNPARSABLE = "unparsable record"
WRONG_TAG = "wrong root tag"
NO_SECOND = "missing epochSecond"
NO_NANO = "missing nanoOfSecond"
BAD_SECOND = "invalid epochSecond"
BAD_NANO = "invalid nanoOfSecond"
NO_TIME = "missing timestamp"
BAD_MILLIS = "invalid timeMillis"
NO_LOGGER = "missing logger"
NO_LEVEL = "missing level"
BAD_LEVEL = "unknown level"
NO_MESSAGE = "missing message"


def parse_log_events(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The fields of XML log records beside their raw text; other columns are kept.

    The parser does not look at the root tag, so it is taken from the text.

    The parsed event comes out of a generator of one row: a filter on its fields
    then stays above the parser. Below it, the optimizer would repeat the parse
    for every field the filter mentions.
    """
    parsed = F.from_xml(
        F.col(raw), LOG_EVENT.simpleString(), {"columnNameOfCorruptRecord": "_corrupt_record"}
    )
    root = F.regexp_extract(raw, r"^\s*(?:<\?.*?\?>\s*)?<([A-Za-z_][\w:.-]*)", 1)
    return records.select(
        "*", root.alias("root_tag"), F.explode(F.array(parsed)).alias("event")
    )


def _reasons() -> Column:
    event = F.col("event")
    instant = event["Instant"]
    second, nano = instant["_epochSecond"], instant["_nanoOfSecond"]
    millis, level = event["_timeMillis"], event["_level"]
    has_instant = instant.isNotNull()

    def when(condition: Column, reason: str) -> Column:
        return F.when(condition, F.lit(reason))

    second_ok = in_range(second.try_cast("long"), MIN_SECOND, MAX_SECOND)
    nano_ok = in_range(nano.try_cast("long"), 0, 999_999_999)
    millis_ok = in_range(millis.try_cast("long"), MIN_SECOND * 1000, MAX_SECOND * 1000 + 999)
    fields = F.array_compact(
        F.array(
            when(has_instant & second.isNull(), NO_SECOND),
            when(has_instant & nano.isNull(), NO_NANO),
            when(has_instant & second.isNotNull() & ~second_ok, BAD_SECOND),
            when(has_instant & nano.isNotNull() & ~nano_ok, BAD_NANO),
            when(~has_instant & millis.isNull(), NO_TIME),
            when(~has_instant & millis.isNotNull() & ~millis_ok, BAD_MILLIS),
            when(event["_loggerName"].isNull(), NO_LOGGER),
            when(level.isNull(), NO_LEVEL),
            when(level.isNotNull() & ~level.isin(LEVELS), BAD_LEVEL),
            when(event["Message"].isNull(), NO_MESSAGE),
        )
    )
    broken = event.isNull() | event["_corrupt_record"].isNotNull()
    return (
        F.when(broken, F.array(F.lit(UNPARSABLE)))
        .when(F.col("root_tag") != "Event", F.array(F.lit(WRONG_TAG)))
        .when(F.size(fields) > 0, fields)
    )


def validate_log_events(parsed: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Flat log events with an array of errors, NULL if there are none.

    A faulty event still gets a timestamp, a level, a logger and a message, so
    that later steps need not look at ``errors``: the time of ingestion, ``INFO``,
    an empty logger and the raw text.
    """
    event = F.col("event")
    instant, thrown = event["Instant"], event["Thrown"]
    time = log_timestamp(
        instant.isNotNull(), instant["_epochSecond"], instant["_nanoOfSecond"], event["_timeMillis"]
    )
    now = F.current_timestamp() if ingest_time is None else ingest_time
    others = [c for c in parsed.columns if c not in ("event", "root_tag", "raw")]
    frames = thrown["ExtendedStackTrace"]["ExtendedStackTraceItem"]
    return parsed.select(
        *others,
        F.coalesce(time, now).alias("timestamp"),
        F.coalesce(instant["_nanoOfSecond"].try_cast("int"), F.lit(0)).alias("nano"),
        F.when(event["_level"].isin(LEVELS), event["_level"])
        .otherwise(F.lit("INFO"))
        .alias("level"),
        F.coalesce(event["_loggerName"], F.lit("")).alias("logger"),
        event["_thread"].alias("thread"),
        F.coalesce(event["Message"], F.col("raw")).alias("message"),
        F.when(
            thrown.isNotNull(),
            F.struct(
                thrown["_name"].alias("name"),
                thrown["_message"].alias("message"),
                F.coalesce(
                    F.transform(
                        frames,
                        lambda f: F.struct(
                            f["_class"].alias("class"),
                            f["_method"].alias("method"),
                            f["_file"].alias("file"),
                            f["_line"].try_cast("int").alias("line"),
                            f["_exact"].try_cast("boolean").alias("exact"),
                            f["_location"].alias("location"),
                            f["_version"].alias("version"),
                        ),
                    ),
                    F.array().cast(
                        "array<struct<class:string,method:string,file:string,line:int,"
                        "exact:boolean,location:string,version:string>>"
                    ),
                ).alias("frames"),
            ),
        ).alias("thrown"),
        _reasons().alias("errors"),
    )


def log_events(records: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Parse and validate raw XML records in one step."""
    return validate_log_events(parse_log_events(records), ingest_time)


# --- filters ----------------------------------------------------------------


def valid_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("errors").isNull())


def invariant_violations(events: DataFrame) -> DataFrame:
    """Events without a time, level, logger or message; there must be none.

    Takes all events, faulty ones too.
    """
    epoch = F.timestamp_seconds(F.lit(0))
    return events.filter(
        (F.col("timestamp") == epoch)
        | F.col("level").isNull()
        | F.col("logger").isNull()
        | F.col("message").isNull()
    )


def _rank(level: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)))
    return F.try_element_at(ranks, level)


def level_filter(
    events: DataFrame,
    thresholds: Mapping[str, str],
    level: str = "level",
    logger: str = "logger",
) -> DataFrame:
    """Events at or above the threshold of their logger.

    A logger takes the threshold of its nearest named parent (``a.b`` covers
    ``a.b.c``), else that of ``ROOT``. The thresholds are configuration, so they
    become one expression and cost no join. An event whose level is none of the
    known ones is left out.
    """
    # ``ALL`` lets every event pass, ``OFF`` none.
    rank = {"ALL": -1, "OFF": len(LEVELS)} | {name: i for i, name in enumerate(LEVELS)}
    least = F.lit(rank[thresholds.get("ROOT", "ALL")])
    named = sorted((name for name in thresholds if name != "ROOT"), key=len)
    for name in named:
        covered = (F.col(logger) == name) | F.col(logger).startswith(name + ".")
        least = F.when(covered, F.lit(rank[thresholds[name]])).otherwise(least)
    return events.filter(_rank(F.col(level)) >= least)


# --- routing ----------------------------------------------------------------


@dataclass(frozen=True)
class Route:
    """A named filter: exact container, and exact pod or cluster and pod suffix."""

    route: str
    container: str
    pod: str | None = None
    cluster: str | None = None
    pod_suffix: str | None = None


ROUTE_SCHEMA = "route string, r_container string, r_pod string, r_cluster string, r_suffix string"


def routes_table(spark: SparkSession, routes: Iterable[Route]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in routes], ROUTE_SCHEMA)


def route(events: DataFrame, routes: list[Route] | DataFrame) -> DataFrame:
    """Each event once per route that takes it, with the name of the route.

    One pass over the events: the container is the join key, the rest of a route
    is checked on the pairs that share it. The route table is broadcast if it is
    small.
    """
    if isinstance(routes, DataFrame):
        table = broadcast_if_small(routes)
    else:
        table = routes_table(events.sparkSession, routes)
        if len(routes) <= BROADCAST_ROWS:
            table = F.broadcast(table)
    matches = (
        (F.col("container") == F.col("r_container"))
        & (F.col("r_pod").isNull() | (F.col("pod") == F.col("r_pod")))
        & (F.col("r_cluster").isNull() | (F.col("cluster") == F.col("r_cluster")))
        & (F.col("r_suffix").isNull() | F.col("pod").endswith(F.col("r_suffix")))
    )
    return events.join(table, matches, "inner").drop(
        "r_container", "r_pod", "r_cluster", "r_suffix"
    )


def count_per_route(events: DataFrame, routes: list[Route] | DataFrame) -> DataFrame:
    """Events per route; a silent route appears with zero.

    The counts are added up before they are shuffled, so a busy route is one
    row per task.
    """
    spark = events.sparkSession
    table = routes if isinstance(routes, DataFrame) else routes_table(spark, routes)
    counted = route(events, routes).groupBy("route").agg(F.count("*").alias("n"))
    return table.select("route").join(counted, "route", "left").select(
        "route", F.coalesce("n", F.lit(0)).cast("long").alias("events")
    )


def silent_routes(events: DataFrame, routes: list[Route] | DataFrame) -> DataFrame:
    """The routes that no event takes; a healthy pipeline has none."""
    return count_per_route(events, routes).filter(F.col("events") == 0).select("route")
