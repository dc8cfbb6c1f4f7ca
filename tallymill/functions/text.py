"""Expressions over log text and log time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and the default of test-run logs.
NAMESPACE_PATTERN = r"(?U)Creating namespace: (kuttl-test-[^\s]+)"
FAILED_TEST_PATTERN = r"(?U)--- FAIL: kuttl/harness/([^\s]+)"
FAILED_STEP_PATTERN = r"(?U)failed in step ([\w\-]+)"
NO_FAILED_STEP = "Could not find failed step"

# Seconds of the first and last instant a SQL timestamp can show (years 1 to 9999).
MIN_SECOND = -62_135_596_800
MAX_SECOND = 253_402_300_799


def run_namespace(text: Column) -> Column:
    """The first namespace a run log names, or NULL."""
    return F.nullif(F.regexp_extract(text, NAMESPACE_PATTERN, 1), F.lit(""))


def failed_tests(text: Column) -> Column:
    """All tests a run log reports as failed, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(FAILED_TEST_PATTERN), F.lit(1))


def failed_step(text: Column) -> Column:
    """The first step a run log reports as failed, or a default text."""
    step = F.regexp_extract(text, FAILED_STEP_PATTERN, 1)
    return F.when(step != "", F.concat(F.lit("failed in step "), step)).otherwise(
        F.lit(NO_FAILED_STEP)
    )


def in_range(value: Column, low: int, high: int) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def instant_timestamp(second: Column, nano: Column) -> Column:
    """Timestamp of a second and a nanosecond, NULL unless both are valid numbers."""
    s, n = second.try_cast("long"), nano.try_cast("long")
    valid = in_range(s, MIN_SECOND, MAX_SECOND) & in_range(n, 0, 999_999_999)
    micros = s * F.lit(1_000_000) + F.floor(n / F.lit(1000))
    return F.when(valid, F.timestamp_micros(micros))


def millis_timestamp(millis: Column) -> Column:
    """Timestamp of epoch milliseconds, NULL unless in range."""
    m = millis.try_cast("long")
    return F.when(
        in_range(m, MIN_SECOND * 1000, MAX_SECOND * 1000 + 999), F.timestamp_millis(m)
    )


def log_timestamp(has_instant: Column, second: Column, nano: Column, millis: Column) -> Column:
    """Time of a log event: the instant if there is one, else the milliseconds.

    A present but faulty instant gives NULL; it never falls back on the milliseconds.
    """
    return F.when(has_instant, instant_timestamp(second, nano)).otherwise(
        millis_timestamp(millis)
    )
