"""Calendar reports, point estimates, word counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.numeric import mean
from tallymill.session import broadcast_if_small, checkpoint


def project_trips(
    trips: DataFrame,
    pickup: str = "tpep_pickup_datetime",
    passengers: str = "passenger_count",
    distance: str = "trip_distance",
    amount: str = "total_amount",
) -> DataFrame:
    """The four columns of the weekday report; 1 is Sunday and 7 is Saturday."""
    return trips.select(
        F.dayofweek(pickup).alias("day_of_week"),
        F.col(passengers).alias("passenger_count"),
        F.col(distance).alias("trip_distance"),
        F.col(amount).alias("total_amount"),
    )


def weekday_report(trips: DataFrame, digits: int | None = None, **columns: str) -> DataFrame:
    """Passengers, mean distance and mean amount per day of the week.

    ``columns`` names the columns as in :func:`project_trips`. ``digits`` is the
    number of decimals the measures carry, where a reproducible mean is needed.
    """
    return (
        project_trips(trips, **columns)
        .groupBy("day_of_week")
        .agg(
            F.sum("passenger_count").alias("total_passengers"),
            mean("trip_distance", digits).alias("avg_trip_distance"),
            mean("total_amount", digits).alias("avg_amount"),
        )
        .orderBy("day_of_week")
    )


def monthly_stats(
    records: DataFrame, date_field: str = "date_field", int_field: str = "int_field"
) -> DataFrame:
    """Count, mean, least and greatest value per month of the year.

    Years fold together. The date may be a date, a timestamp or ``yyyy-MM-dd`` text.
    """
    return (
        records.groupBy(F.month(date_field).alias("month"))
        .agg(
            F.count("*").alias("count"),
            F.avg(int_field).alias("avg_int_field"),
            F.min(int_field).alias("min_int_field"),
            F.max(int_field).alias("max_int_field"),
        )
        .orderBy("month")
    )


# Steps of the additive recurrence that spreads points evenly over the unit
# square, 1/g and 1/g^2 for the real root g of g^3 = g + 1, in parts of a whole
# turn. Products of two parts fit into 64 bits.
CIRCLE = 1 << 31
STEP_X, STEP_Y = (round(CIRCLE * step) | 1 for step in (0.7548776662466927, 0.5698402909980532))


def estimate_pi(points: DataFrame, index: str | Column = "id") -> DataFrame:
    """Four times the share of points that fall into the unit circle.

    A point follows from its index, so a task that runs again gives the same one.
    It is computed in whole numbers, so large indexes are as good as small ones;
    after 2**31 points the same ones come again.
    """
    i = F.pmod((F.col(index) if isinstance(index, str) else index).cast("long"), F.lit(CIRCLE))
    x, y = (i * F.lit(step) % F.lit(CIRCLE) / F.lit(float(CIRCLE)) for step in (STEP_X, STEP_Y))
    inside = F.count_if(x * x + y * y <= 1.0)
    return points.agg(
        F.count("*").alias("points"),
        inside.alias("inside"),
        F.try_divide(inside * F.lit(4.0), F.count("*")).alias("pi"),
    )


def words(lines: DataFrame, value: str = "value") -> DataFrame:
    """The words of each line, cut at single spaces; an empty line is one empty word."""
    return lines.select(F.explode(F.split(value, " ")).alias("word"))


def word_count(lines: DataFrame, value: str = "value") -> DataFrame:
    return words(lines, value).groupBy("word").agg(F.count("*").alias("count"))


def anomaly_scores(rows: DataFrame, group: str, value: str, threshold: float = 3.0) -> DataFrame:
    """Every row with its distance from the mean of its group, in standard deviations.

    The statistics are aggregated first and written once. They are broadcast if
    there are few groups, so the rows themselves are not shuffled. ``rows`` is
    read twice; checkpoint it first if it is expensive to compute.
    """
    stats = checkpoint(
        rows.groupBy(group).agg(
            F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_stddev")
        )
    )
    score = F.try_divide(F.col(value) - F.col("group_mean"), F.col("group_stddev"))
    stats = stats.withColumnRenamed(group, "_group")
    return (
        rows.join(broadcast_if_small(stats), F.col(group).eqNullSafe(F.col("_group")), "left")
        .withColumn("score", score)
        .withColumn("anomaly", F.coalesce(F.abs("score") > threshold, F.lit(False)))
        .drop("_group", "group_mean", "group_stddev")
    )
