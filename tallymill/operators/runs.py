"""Run histories: thresholds, bounded history, statistics and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallymill.functions.numeric import histogram, histogram_mean, histogram_median, mean
from tallymill.functions.text import failed_step, failed_tests, run_namespace

# Shorter runs are quick failures, older runs are forgotten.
MIN_RUNTIME = 30.0
MAX_HISTORY = 50

#: Spark cuts a ranked window before the shuffle up to this rank.
WINDOW_GROUP_LIMIT = 1000
_SALTS = 64


def extract_run_ids(logs: DataFrame, text: str = "text") -> DataFrame:
    """Namespace, failed tests and failed step of each log text."""
    t = F.col(text)
    return logs.select(
        *(c for c in logs.columns if c != text),
        run_namespace(t).alias("namespace"),
        failed_tests(t).alias("failed_tests"),
        failed_step(t).alias("failed_step"),
    )


def min_duration(
    runs: DataFrame, least: float = MIN_RUNTIME, duration: str = "duration"
) -> DataFrame:
    """Runs of at least the given duration."""
    return runs.filter(F.col(duration) >= F.lit(least))


def _last(runs: DataFrame, key: list[str], order: list[Column], n: int, order_columns: list[str]) -> DataFrame:
    """The first n rows per key in an order, cut on the way into the shuffle.

    Up to a rank of 1000 Spark does this cut by itself. Beyond that the rows of a
    key are first spread over salts and cut there.
    """
    if n > WINDOW_GROUP_LIMIT:
        salted = Window.partitionBy(*key, "_salt").orderBy(*order)
        # the order says which rows differ; other columns may be of types without a hash
        salt = F.pmod(F.xxhash64(*order_columns), F.lit(_SALTS))
        runs = (
            runs.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(salted))
            .filter(F.col("_rank") <= n)
            .drop("_salt", "_rank")
        )
    window = Window.partitionBy(*key).orderBy(*order)
    return (
        runs.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def last_n(
    runs: DataFrame, key: str | list[str], order: list[str], n: int = MAX_HISTORY
) -> DataFrame:
    """The most recent n rows per key; later entries of ``order`` break ties."""
    keys = [key] if isinstance(key, str) else key
    return _last(runs, keys, [F.col(c).desc() for c in order], n, order)


def runtime_stats(
    runs: DataFrame,
    key: str = "test_name",
    order: list[str] | None = None,
    duration: str = "duration",
    least: float = MIN_RUNTIME,
    n: int = MAX_HISTORY,
    digits: int | None = None,
) -> DataFrame:
    """Mean, median, least and greatest duration per key over the kept history.

    Runs that are too short are dropped before the cut; a key with no others
    gets zeros. It keeps one place in the ranking for that, behind all long runs,
    which saves a join with the list of keys.
    """
    order = order or ["ts"]
    long = F.col(duration) >= F.lit(least)
    kept = _last(
        runs.select(key, *order, F.when(long, F.col(duration)).alias("_kept")),
        [key],
        [F.col("_kept").isNotNull().desc(), *(F.col(c).desc() for c in order)],
        n,
        order,
    )

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    return kept.groupBy(key).agg(
        zero(mean("_kept", digits)).alias("mean"),
        zero(F.median("_kept")).alias("median"),
        zero(F.min("_kept")).alias("min"),
        zero(F.max("_kept")).alias("max"),
        F.count("_kept").alias("runs"),
    )


def overall_runtime(
    history: DataFrame, duration: str = "duration", digits: int | None = None
) -> DataFrame:
    """Mean, median, fastest and slowest duration over all keys.

    The history is read once, into a histogram; all statistics come from that.
    For whole numbers and decimals the order statistics are exact decimals, the
    median with one digit more; for anything else they are doubles.
    """
    values = histogram(history, duration)
    middle = F.lit(histogram_median(values))
    kind = values.schema["v"].dataType
    if isinstance(kind, DecimalType):
        middle = middle.cast(DecimalType(min(38, kind.precision + 1), min(kind.scale + 1, 37)))
    else:
        middle = middle.cast("double")
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("runs"),
        histogram_mean(digits).alias("mean"),
        middle.alias("median"),
        F.min("v").alias("fastest"),
        F.max("v").alias("slowest"),
    )


def classify_outcome(
    attempts: DataFrame,
    key: str | list[str] = "test_name",
    attempt: str = "attempt",
    success: str = "success",
    namespace: str = "namespace",
    reason: str = "failed_step",
) -> DataFrame:
    """Status of each key over its attempts: passed, flaky or failed.

    Passed at once, passed on a retry, or never. For the last kind the reason of
    the last retry and the last namespace a retry has kept are reported. All of
    it is one aggregation with a map-side part.
    """
    keys = [key] if isinstance(key, str) else key
    order = F.col(attempt)
    named = F.when(F.col(namespace).isNotNull(), order)
    merged = attempts.groupBy(*keys).agg(
        F.count("*").alias("total_attempts"),
        F.min_by(success, order).alias("_first_ok"),
        F.bool_or(success).alias("_any_ok"),
        F.min(order).alias("_first"),
        F.max_by(reason, order).alias("_reason"),
        F.max_by(namespace, named).alias("_namespace"),
        F.max(named).alias("_named"),
    )
    status = (
        F.when(F.col("_first_ok"), "passed").when(F.col("_any_ok"), "flaky").otherwise("failed")
    )
    failed = F.col("final_status") == "failed"
    retried = F.col("total_attempts") > 1
    # The first attempt is no retry, so its reason and namespace do not count.
    return merged.withColumn("final_status", status).select(
        *keys,
        "final_status",
        "total_attempts",
        F.when(failed & retried, F.col("_reason")).alias("last_reason"),
        F.when(failed & (F.col("_named") > F.col("_first")), F.col("_namespace")).alias(
            "final_namespace"
        ),
    )


def outcome_totals(summary: DataFrame) -> DataFrame:
    """Keys per status and the share that passed in the end, in percent."""

    def of(status: str) -> Column:
        return F.count_if(F.col("final_status") == status)

    return summary.agg(
        F.count("*").alias("total"),
        of("passed").alias("passed"),
        of("flaky").alias("flaky"),
        of("failed").alias("failed"),
        (
            (of("passed") + of("flaky")) / F.greatest(F.lit(1), F.count("*")) * F.lit(100.0)
        ).alias("success_rate"),
    )


def top_slowest(stats: DataFrame, n: int = 3, key: str = "test_name") -> DataFrame:
    """The n keys with the greatest mean; equal means in the order of the key."""
    return stats.orderBy(F.col("mean").desc(), F.col(key)).limit(n)


def top_fastest(stats: DataFrame, n: int = 3, key: str = "test_name") -> DataFrame:
    return stats.orderBy(F.col("mean"), F.col(key)).limit(n)
