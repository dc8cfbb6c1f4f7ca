"""Log text, log files and documents that Spark derives from the provided tables.

Where the SQL twin needs the same text, the expression is written once in the
SQL both engines share; only time arithmetic differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.logs import Route
from tallymill.plans.registry import table
from tallymill.session import spread


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC.

    Taken from its day and clock, since a difference of such timestamps would
    go through the time zone of the session.
    """
    minutes = (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), F.col(ts))
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


# --- XML log records --------------------------------------------------------

LEVEL_OF = {
    "signup": "INFO",
    "click": "DEBUG",
    "view": "TRACE",
    "error": "ERROR",
    "purchase": "WARN",
}
LEVEL = (
    "CASE event_type "
    + " ".join(f"WHEN '{kind}' THEN '{level}'" for kind, level in LEVEL_OF.items())
    + " END"
)

# The event number decides what is wrong with a record, in fourteen cases.
CASE = "event_id % 14"
NAMESPACE = "http://logging.apache.org/log4j/2.0/events"
RAW = f"""
'<' || CASE WHEN {CASE} = 11 THEN 'NoEvent' ELSE 'Event' END || ' xmlns="{NAMESPACE}"'
|| CASE WHEN {CASE} = 5 THEN ''
        WHEN {CASE} = 6 THEN ' timeMillis="10000000000000000"'
        ELSE ' timeMillis="' || CAST(millis AS STRING) || '"' END
|| ' thread="user-' || CAST(user_id AS STRING) || '"'
|| CASE WHEN {CASE} = 8 THEN ''
        WHEN {CASE} = 9 THEN ' level="CRITICAL"'
        ELSE ' level="' || {LEVEL} || '"' END
|| CASE WHEN {CASE} = 7 THEN '' ELSE ' loggerName="shop.' || event_type || '"' END
|| ' threadId="1" threadPriority="5">'
|| CASE WHEN {CASE} IN (1, 5, 6) THEN ''
        WHEN {CASE} = 2 THEN '<Instant nanoOfSecond="' || CAST(nano AS STRING) || '"/>'
        WHEN {CASE} = 3 THEN '<Instant epochSecond="' || CAST(sec AS STRING) || '"/>'
        WHEN {CASE} = 4 THEN '<Instant epochSecond="10000000000000" nanoOfSecond="0"/>'
        ELSE '<Instant epochSecond="' || CAST(sec AS STRING) || '" nanoOfSecond="'
             || CAST(nano AS STRING) || '"/>' END
|| CASE WHEN {CASE} = 10 THEN ''
        ELSE '<Message>event ' || CAST(event_id AS STRING) || ' ' || props || '</Message>' END
|| CASE WHEN {CASE} = 12 THEN '<Invalid tag ...' ELSE '' END
|| CASE WHEN event_type = 'error' THEN
     '<Thrown name="ShopError" message="no stock"><ExtendedStackTrace>'
     || '<ExtendedStackTraceItem class="Shop" method="sell" file="Shop.java" line="12" exact="true"/>'
     || '<ExtendedStackTraceItem class="Shop" method="run" file="Shop.java" line="34" exact="false"/>'
     || '</ExtendedStackTrace></Thrown>' ELSE '' END
|| CASE WHEN {CASE} = 11 THEN '</NoEvent>' ELSE '</Event>' END
"""

CONFIG = "CASE WHEN user_id % 2 = 0 THEN 'automatic' ELSE 'custom' END"
CLUSTER = (
    "CASE WHEN user_id % 6 < 2 THEN 'spark-history' "
    f"WHEN user_id % 6 < 4 THEN 'spark-' || {CONFIG} || '-log-config' "
    f"ELSE 'pyspark-' || {CONFIG} || '-log-config' END"
)
POD = (
    f"CASE WHEN user_id % 6 < 2 THEN 'spark-history-node-' || {CONFIG} || '-log-config-0' "
    f"ELSE {CLUSTER} || '-' || CAST(user_id AS STRING) || "
    "CASE event_id % 3 WHEN 0 THEN '-driver' WHEN 1 THEN '-exec-1' ELSE '-exec-2' END END"
)
CONTAINER = (
    "CASE event_type WHEN 'signup' THEN 'spark-history' WHEN 'click' THEN 'spark' "
    "WHEN 'view' THEN 'job' WHEN 'error' THEN 'vector' ELSE 'requirements' END"
)

#: The start of an SQL twin over rendered log records.
RECORDS_CTE = f"""
clocked AS (
  SELECT *, epoch_us(ts) // 1000 AS millis, epoch_us(ts) // 1000000 AS sec,
         (epoch_us(ts) % 1000000) * 1000 AS nano
  FROM events),
records AS (
  SELECT *, {RAW} AS raw, {CLUSTER} AS cluster, {POD} AS pod, {CONTAINER} AS container,
         {CASE} AS c, {LEVEL} AS lvl
  FROM clocked)"""


def render_records(events: DataFrame) -> DataFrame:
    """Log records of an event table or stream, with the pod they come from."""
    micros = epoch_micros("ts")
    return (
        events.withColumn("micros", micros)
        .withColumn("millis", F.expr("micros div 1000"))
        .withColumn("sec", F.expr("micros div 1000000"))
        .withColumn("nano", F.expr("(micros % 1000000) * 1000"))
        .select(
            "event_id",
            F.expr(RAW).alias("raw"),
            F.expr(CLUSTER).alias("cluster"),
            F.expr(POD).alias("pod"),
            F.expr(CONTAINER).alias("container"),
        )
    )


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_records(spread(table(spark, sf_dir, "events")))


SILENT = Route("silent", "nobody")


def default_routes() -> list[Route]:
    """The routes of a history server and four applications, 28 in all."""
    # Names of pods, clusters and containers.
    configs = ["automatic", "custom"]
    containers = {
        "spark": ["spark", "job", "vector"],
        "pyspark": ["spark", "requirements", "vector"],
    }
    routes = []
    for config in configs:
        pod = f"spark-history-node-{config}-log-config-0"
        routes += [Route(f"{pod}/{c}", c, pod=pod) for c in ("spark-history", "vector")]
    for kind, names in containers.items():
        for config in configs:
            cluster = f"{kind}-{config}-log-config"
            for suffix in ("-driver", "-exec-1"):
                routes += [
                    Route(f"{cluster}{suffix}/{c}", c, cluster=cluster, pod_suffix=suffix)
                    for c in names
                ]
    return routes


def routes() -> list[Route]:
    """All routes and one that no event takes."""
    return [*default_routes(), SILENT]


def routes_values() -> str:
    """The same routes as an SQL table."""

    def text(value: str | None) -> str:
        return "NULL" if value is None else f"'{value}'"

    rows = ", ".join(
        "("
        + ", ".join(text(v) for v in (r.route, r.container, r.pod, r.cluster, r.pod_suffix))
        + ")"
        for r in routes()
    )
    return f"(VALUES {rows}) AS r(route, r_container, r_pod, r_cluster, r_suffix)"


# --- application event logs -------------------------------------------------


def application_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-log lines with one application per user: a start, its jobs, maybe an end.

    A user with an odd number of events has not finished.
    """
    events = table(spark, sf_dir, "events")
    timed = events.withColumn("millis", F.floor(epoch_micros("ts") / 1000).cast("long"))
    bounds = timed.groupBy("user_id").agg(
        F.min("millis").alias("first"),
        F.max("millis").alias("last"),
        F.max("ts").cast("timestamp").alias("modified"),
        F.count("*").alias("n"),
    )
    log = F.concat(F.lit("app-"), F.col("user_id").cast("string"))
    first = F.format_string(
        '{"Event":"SparkListenerApplicationStart","App Name":"shop %d","App ID":"app-%d",'
        '"Timestamp":%d,"User":"u%d"}',
        "user_id",
        "user_id",
        "first",
        F.expr("user_id % 5"),
    )
    last = F.format_string('{"Event":"SparkListenerApplicationEnd","Timestamp":%d}', "last")
    framing = F.array_compact(F.array(first, F.when(F.col("n") % 2 == 0, last)))
    job = F.format_string(
        '{"Event":"SparkListenerJobStart","Job ID":%d,"Submission Time":%d}', "event_id", "millis"
    )
    return bounds.select(log.alias("log"), "modified", F.explode(framing).alias("value")).unionByName(
        timed.select(log.alias("log"), F.col("ts").cast("timestamp").alias("modified"), job.alias("value"))
    )


# --- layered documents ------------------------------------------------------

#: One document per event, which is a layer of its user.
DOCS_CTE = """
docs AS (
  SELECT user_id, event_id AS layer, event_type AS t, value AS v,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial documents per user: every event is a layer, the later the higher."""
    events = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    last = events.select(
        "user_id", F.col("event_id").alias("layer"), F.col("event_type").alias("t"),
        F.col("value").alias("v"), k.alias("k"),
    )
    t, v, text = F.col("t"), F.col("v"), F.col("k").cast("string")
    conf = F.when(t != "view", F.create_map(t, v.cast("string"), F.lit("k"), text))
    return last.select(
        "user_id",
        "layer",
        F.concat(F.lit("layer-"), F.col("layer").cast("string")).alias("name"),
        t.alias("main_application_file"),
        F.when(v > 30, F.concat(F.lit("class."), t)).alias("main_class"),
        conf.alias("spark_conf"),
        F.when(t != "click", F.array(t, text)).alias("args"),
        F.when(F.col("k") % 2 == 0, F.col("k")).alias("replicas"),
        F.struct(
            F.when(t != "error", F.create_map(t, text)).alias("env_overrides"),
            F.when(t == "error", F.create_map(F.lit("level"), t)).alias("config_overrides"),
        ).alias("job"),
        F.when(
            t != "view",
            F.struct(
                F.when(t != "error", F.col("k")).alias("cores"),
                F.when(t == "signup", v).alias("memory"),
            ),
        ).alias("config"),
        F.array(
            F.struct(
                t.alias("name"),
                F.create_map(F.lit("cpu"), F.concat(text, F.lit("m"))).alias("requests"),
                F.when(v > 30, F.create_map(F.lit("memory"), F.concat(text, F.lit("Mi")))).alias(
                    "limits"
                ),
            ),
            F.struct(
                F.lit("sidecar").alias("name"),
                F.create_map(t, text).alias("requests"),
                F.lit(None).cast("map<string,string>").alias("limits"),
            ),
        ).alias("containers"),
        F.array(
            F.struct(t.alias("name"), text.alias("value")),
            F.struct(F.lit("HOUR").alias("name"), F.col("layer").cast("string").alias("value")),
        ).alias("env"),
    )


def map_text(column: str | Column) -> Column:
    """A map as text, sorted by key."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )
