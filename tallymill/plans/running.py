"""Run histories, outcomes and capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.quantities import cores, mib, usable_mib
from tallymill.functions.text import NO_FAILED_STEP
from tallymill.operators.capacity import capacity_rollup
from tallymill.operators.runs import (
    MAX_HISTORY,
    MIN_RUNTIME,
    classify_outcome,
    extract_run_ids,
    last_n,
    min_duration,
    outcome_totals,
    overall_runtime,
    runtime_stats,
    top_fastest,
    top_slowest,
)
from tallymill.plans.registry import query, table
from tallymill.plans.reporting import exact

ORDER = ["ts", "event_id"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("test_name"), "ts", "event_id", F.col("value").alias("duration")
    )


# --- log texts --------------------------------------------------------------

LINES = """
CASE WHEN event_id % 3 = 0 THEN 'no namespace'
     ELSE 'Creating namespace: kuttl-test-' || CAST(user_id AS STRING) || ' now' END
|| chr(10) || '--- FAIL: kuttl/harness/' || event_type || '_' || CAST(user_id AS STRING) || ' (1s)'
|| chr(10) || 'Creating namespace: kuttl-test-second'
|| CASE WHEN event_type = 'view' THEN chr(10) || '--- FAIL: kuttl/harness/again' ELSE '' END
|| CASE WHEN event_type = 'error'
        THEN chr(10) || 'failed in step 10-' || event_type || ': no' || chr(10) || 'failed in step 20'
        ELSE '' END
"""


@query(
    "run_ids",
    f"""SELECT event_id,
          CASE WHEN event_id % 3 = 0 THEN 'kuttl-test-second' ELSE 'kuttl-test-' || user_id END AS namespace,
          event_type || '_' || user_id
            || CASE WHEN event_type = 'view' THEN ',again' ELSE '' END AS failed_tests,
          CASE WHEN event_type = 'error' THEN 'failed in step 10-error' ELSE '{NO_FAILED_STEP}' END
            AS failed_step
        FROM events""",
)
def _run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select("event_id", F.expr(LINES).alias("text"))
    return extract_run_ids(logs).withColumn("failed_tests", F.array_join("failed_tests", ","))


# --- histories --------------------------------------------------------------


@query(
    "long_runs",
    f"SELECT user_id AS test_name, event_id, value AS duration FROM events WHERE value >= {MIN_RUNTIME}",
)
def _long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_duration(runs(spark, sf_dir)).select("test_name", "event_id", "duration")


HISTORY = f"""
SELECT user_id AS test_name, event_id, value AS duration FROM events WHERE value >= {MIN_RUNTIME}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= {MAX_HISTORY}"""


@query("run_history", HISTORY)
def _run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = last_n(min_duration(runs(spark, sf_dir)), "test_name", ORDER)
    return kept.select("test_name", "event_id", "duration")


@query(
    "long_run_history",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
               <= 2000""",
)
def _long_run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history longer than the engine cuts by itself."""
    orders = table(spark, sf_dir, "orders")
    kept = last_n(orders, "o_custkey", ["o_orderdate", "o_orderkey"], n=2000)
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


STATS = f"""
SELECT test_name, coalesce({exact('duration')}, 0.0) AS mean,
       coalesce(round(median(duration), 4), 0.0) AS median,
       coalesce(min(duration), 0.0) AS min, coalesce(max(duration), 0.0) AS max,
       count(duration) AS runs
FROM (SELECT DISTINCT user_id AS test_name FROM events) LEFT JOIN ({HISTORY}) USING (test_name)
GROUP BY test_name"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = runtime_stats(runs(spark, sf_dir), order=ORDER, digits=2)
    return stats.withColumn("median", F.round("median", 4))


@query("runtime_stats", STATS)
def _runtime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(
    "runtime_stats_empty",
    """SELECT o_custkey AS test_name, coalesce(max(o_totalprice) FILTER (o_totalprice >= 400000), 0.0)
              AS max, least(count(*) FILTER (o_totalprice >= 400000), 50) AS runs
       FROM orders GROUP BY 1""",
)
def _runtime_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many keys have no run above this threshold and get zeros."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "test_name")
    order = ["o_totalprice", "o_orderkey"]
    stats = runtime_stats(orders, order=order, duration="o_totalprice", least=400_000.0)
    return stats.select("test_name", "max", "runs")


@query(
    "overall_runtime",
    f"""SELECT count(*) AS runs, {exact('duration')} AS mean, round(median(duration), 4) AS median,
               min(duration) AS fastest, max(duration) AS slowest FROM ({HISTORY})""",
)
def _overall_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = last_n(min_duration(runs(spark, sf_dir)), "test_name", ORDER)
    overall = overall_runtime(history, digits=2)
    return overall.withColumn("median", F.round("median", 4))


@query(
    "overall_price",
    f"""SELECT count(*) AS runs, {exact('l_extendedprice')} AS mean,
               round(median(l_extendedprice), 4) AS median,
               min(l_extendedprice) AS fastest, max(l_extendedprice) AS slowest FROM lineitem""",
)
def _overall_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over a table with many distinct values."""
    overall = overall_runtime(table(spark, sf_dir, "lineitem"), "l_extendedprice", digits=2)
    return overall.withColumn("median", F.round("median", 4))


@query("slowest_tests", f"SELECT * FROM ({STATS}) ORDER BY mean DESC, test_name LIMIT 3")
def _slowest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_slowest(_stats(spark, sf_dir))


@query("fastest_tests", f"SELECT * FROM ({STATS}) ORDER BY mean, test_name LIMIT 3")
def _fastest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_fastest(_stats(spark, sf_dir))


# --- outcomes ---------------------------------------------------------------

ATTEMPTS = """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id AS attempt,
       event_type NOT IN ('error', 'view', 'click') AS success,
       CASE WHEN event_type = 'error' THEN 'ns-' || event_id END AS namespace,
       CASE WHEN event_type <> 'click' THEN 'failed in step ' || event_type END AS failed_step
FROM events"""

OUTCOMES = f"""
SELECT user_id, day, status AS final_status, n AS total_attempts,
       CASE WHEN status = 'failed' THEN last_reason END AS last_reason,
       CASE WHEN status = 'failed' THEN last_ns END AS final_namespace
FROM (
  SELECT user_id, day, count(*) AS n,
         CASE WHEN bool_or(success) FILTER (rn = 1) THEN 'passed'
              WHEN bool_or(success) THEN 'flaky' ELSE 'failed' END AS status,
         max(failed_step) FILTER (rn > 1 AND back = 1) AS last_reason,
         arg_max(namespace, attempt) FILTER (rn > 1 AND namespace IS NOT NULL) AS last_ns
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY attempt) AS rn,
               row_number() OVER (PARTITION BY user_id, day ORDER BY attempt DESC) AS back
        FROM ({ATTEMPTS}))
  GROUP BY user_id, day)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    attempts = table(spark, sf_dir, "events").select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_id").alias("attempt"),
        (~kind.isin("error", "view", "click")).alias("success"),
        F.when(kind == "error", F.concat(F.lit("ns-"), F.col("event_id").cast("string"))).alias(
            "namespace"
        ),
        F.when(kind != "click", F.concat(F.lit("failed in step "), kind)).alias("failed_step"),
    )
    return classify_outcome(attempts, ["user_id", "day"])


@query("test_outcomes", OUTCOMES)
def _test_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query(
    "outcome_totals",
    f"""SELECT count(*) AS total, count(*) FILTER (final_status = 'passed') AS passed,
               count(*) FILTER (final_status = 'flaky') AS flaky,
               count(*) FILTER (final_status = 'failed') AS failed,
               count(*) FILTER (final_status <> 'failed')::DOUBLE
                 / greatest(1, count(*)) * 100.0::DOUBLE AS success_rate
        FROM ({OUTCOMES})""",
)
def _outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_totals(outcomes(spark, sf_dir))


# --- quantities and capacity ------------------------------------------------

CPU = "CASE WHEN p_size % 2 = 0 THEN (p_size * 50) || 'm' ELSE CAST(p_size / 4.0::DOUBLE AS VARCHAR) END"


@query(
    "core_quantities",
    """SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN ceil(p_size * 50 / 1000)
                              ELSE ceil(p_size / 4) END AS BIGINT) AS cores
       FROM part""",
)
def _core_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    quantity = F.when(size % 2 == 0, F.concat((size * 50).cast("string"), F.lit("m"))).otherwise(
        (size / 4).cast("string")
    )
    return table(spark, sf_dir, "part").select("p_partkey", cores(quantity).alias("cores"))


def _heap(mebi: str, overhead: float) -> str:
    """Usable MiB of whole MiB, in single precision as the quantities are."""
    factor = f"(1::FLOAT / (1::FLOAT + {overhead}::FLOAT))::FLOAT"
    reduced = f"CAST(floor(CAST({mebi} AS FLOAT) * {factor}) AS BIGINT)"
    return (
        f"CASE WHEN {mebi} < 384 THEN {mebi} ELSE {mebi} - greatest(384, {mebi} - {reduced}) END"
    )


MEBI = "CAST(floor(p_retailprice) AS BIGINT)"
GIBI = "CAST(p_size * 1024 AS BIGINT)"


@query(
    "memory_quantities",
    f"""SELECT p_partkey, {MEBI} AS mib, CAST({_heap(MEBI, 0.1)} AS BIGINT) AS jvm_mib,
               CAST({_heap(GIBI, 0.4)} AS BIGINT) AS other_mib
        FROM part""",
)
def _memory_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    mebi = F.concat(F.floor("p_retailprice").cast("string"), F.lit("Mi"))
    gibi = F.concat(F.col("p_size").cast("string"), F.lit("Gi"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        mib(mebi).alias("mib"),
        usable_mib(mebi, True).alias("jvm_mib"),
        usable_mib(gibi, False).alias("other_mib"),
    )


APP = f"""
SELECT p_brand,
       CAST(ceil(p_size * 50 / 1000) + (p_partkey % 4) * ceil(p_size / 4) AS BIGINT) AS cores,
       CASE WHEN p_type = 'ECONOMY' THEN {_heap(MEBI, 0.1)} ELSE {_heap(MEBI, 0.4)} END
         + (p_partkey % 4) * CASE WHEN p_type = 'ECONOMY' THEN {_heap(GIBI, 0.1)}
                                  ELSE {_heap(GIBI, 0.4)} END AS mem
FROM part"""


@query(
    "capacity_rollup",
    f"""SELECT coalesce(p_brand, 'total') AS p_brand, count(*) AS apps,
               CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(mem) AS BIGINT) AS memory_mib
        FROM ({APP}) GROUP BY ROLLUP (p_brand)""",
)
def _capacity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "part").select(
        "p_brand",
        F.concat((F.col("p_size") * 50).cast("string"), F.lit("m")).alias("driver_cpu"),
        F.concat(F.floor("p_retailprice").cast("string"), F.lit("Mi")).alias("driver_memory"),
        (F.col("p_size") / 4).cast("string").alias("executor_cpu"),
        F.concat(F.col("p_size").cast("string"), F.lit("Gi")).alias("executor_memory"),
        (F.col("p_partkey") % 4).alias("replicas"),
        (F.col("p_type") == "ECONOMY").alias("jvm"),
    )
    return capacity_rollup(specs, "p_brand")
