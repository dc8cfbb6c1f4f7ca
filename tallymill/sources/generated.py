"""Small typed literals and reproducible generated records."""

from __future__ import annotations

import string
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A prime below which ids are folded, so that products of ids stay in range.
FOLD = 2_147_483_647
# Turns small factors into ones that spread neighbouring ids over the whole range.
STRETCH = 1_327_217_885
LETTERS = string.ascii_letters
TEXT_LENGTH = 10


def typed_literals(spark: SparkSession) -> DataFrame:
    """Three rows of long, double, string, date and timestamp."""
    # One row per line.
    rows = [
        (1, 2.0, "string1", date(2000, 1, 1), datetime(2000, 1, 1, 12, 0)),
        (2, 3.0, "string2", date(2000, 2, 1), datetime(2000, 1, 2, 12, 0)),
        (4, 5.0, "string3", date(2000, 3, 1), datetime(2000, 1, 3, 12, 0)),
    ]
    return spark.createDataFrame(rows, "a long, b double, c string, d date, e timestamp")


def records_for(ids: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """One record per id: a number in 1..1000, ten letters and a day in 2021.

    Everything is integer arithmetic on the id, so a task that runs again
    produces the same rows.
    """
    key = F.col(id_column).cast("long")
    folded = F.pmod(key, F.lit(FOLD))

    def spread(factor: int, modulus: int) -> Column:
        # Folding by the prime again keeps the columns from repeating each other.
        return F.pmod(F.pmod(folded * F.lit(factor * STRETCH % FOLD) + F.lit(seed), F.lit(FOLD)), F.lit(modulus))

    letters = [
        F.substring(F.lit(LETTERS), (spread(618_033 + 12_347 * i, len(LETTERS)) + 1).cast("int"), 1)
        for i in range(TEXT_LENGTH)
    ]
    days = F.pmod(key, F.lit(12)) * 30 + spread(271_829, 30)
    day = F.date_add(F.to_date(F.lit("2021-01-01")), days.cast("int"))
    return ids.select(
        key.alias("id"),
        (spread(381_967, 1000) + 1).alias("int_field"),
        F.concat(*letters).alias("text_field"),
        F.date_format(day, "yyyy-MM-dd").alias("date_field"),
    )


def generate_records(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` records, generated where they are needed."""
    return records_for(spark.range(n), "id", seed)
