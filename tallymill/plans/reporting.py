"""Reports, estimates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.recommend import factorise
from tallymill.operators.reports import (
    CIRCLE,
    STEP_X,
    STEP_Y,
    anomaly_scores,
    estimate_pi,
    monthly_stats,
    project_trips,
    weekday_report,
    word_count,
)
from tallymill.plans.registry import query, table
from tallymill.session import checkpoint, spread

TRIPS = {
    "pickup": "l_shipdate",
    "passengers": "l_quantity",
    "distance": "l_discount",
    "amount": "l_extendedprice",
}


def exact(column: str) -> str:
    """The mean of a column with two decimals, in SQL that does not round on the way."""
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) / count({column})"


WEEKDAYS = f"""
SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week,
       sum(l_quantity) AS total_passengers,
       {exact('l_discount')} AS avg_trip_distance,
       {exact('l_extendedprice')} AS avg_amount
FROM lineitem GROUP BY 1 ORDER BY 1"""

MONTHS = """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS count,
       avg(o_custkey) AS avg_int_field, min(o_custkey) AS min_int_field,
       max(o_custkey) AS max_int_field
FROM orders GROUP BY 1 ORDER BY 1"""


@query("weekday_report", WEEKDAYS)
def _weekday_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekday_report(table(spark, sf_dir, "lineitem"), digits=2, **TRIPS)


@query(
    "trip_projection",
    """SELECT CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS day_of_week,
              l_quantity AS passenger_count, l_discount AS trip_distance,
              l_extendedprice AS total_amount FROM lineitem""",
)
def _trip_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_trips(table(spark, sf_dir, "lineitem"), **TRIPS)


@query(
    "renamed_aggregates",
    """SELECT l_returnflag, sum(l_quantity) AS total_quantity, max(l_tax) AS greatest_tax
       FROM lineitem GROUP BY 1""",
)
def _renamed_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg({"l_quantity": "sum", "l_tax": "max"})
        .withColumnRenamed("sum(l_quantity)", "total_quantity")
        .withColumnRenamed("max(l_tax)", "greatest_tax")
    )


@query(
    "weekday_numbers",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
              CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week, count(*) AS orders
       FROM orders GROUP BY 1, 2""",
)
def _weekday_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    number = F.dayofweek("o_orderdate").alias("day_of_week")
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(day, number).agg(F.count("*").alias("orders"))


@query(
    "month_of_text",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
              CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS orders
       FROM orders GROUP BY 1, 2""",
)
def _month_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    days = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return days.groupBy("day", F.month("day").alias("month")).agg(F.count("*").alias("orders"))


@query("monthly_stats", MONTHS)
def _monthly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_stats(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey")


@query(
    "ordered_report",
    """SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n
       FROM lineitem GROUP BY 1 ORDER BY 1""",
)
def _ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.groupBy(month).agg(F.count("*").alias("n")).orderBy("month")


@query(
    "estimate_pi",
    f"""SELECT count(*) AS points, count(*) FILTER (inside) AS inside,
               4.0::DOUBLE * count(*) FILTER (inside) / count(*) AS pi
        FROM (SELECT x * x + y * y <= 1.0 AS inside FROM (
                SELECT (o_orderkey % {CIRCLE} * {STEP_X} % {CIRCLE})::DOUBLE / {CIRCLE} AS x,
                       (o_orderkey % {CIRCLE} * {STEP_Y} % {CIRCLE})::DOUBLE / {CIRCLE} AS y
                FROM orders))""",
)
def _estimate_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_pi(table(spark, sf_dir, "orders"), "o_orderkey")


WORDS = """
SELECT word, count(*) AS count FROM (
  SELECT unnest(string_split(line, ' ')) AS word FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY word"""


@query("word_count", WORDS)
def _word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("text"))
    return word_count(documents.select(F.explode(F.split("text", "\n")).alias("value")))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer has bought of each part."""
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(F.sum("l_quantity").alias("rating"))
    )


@query("factorised_ratings")
def _factorised_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorise(_ratings(spark, sf_dir)).report.select("ratings", "rmse")


@query(
    "factorisation_of_keys",
    """WITH r AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT count(*) AS ratings, count(DISTINCT o_custkey) AS users, count(DISTINCT l_partkey) AS items,
              count(*) AS predicted, true AS better_than_the_mean FROM r""",
)
def _factorisation_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers have numbers beyond 32 bits here, and parts are named by text."""
    ratings = checkpoint(_ratings(spark, sf_dir)).select(
        (F.col("user") + 3_000_000_000).alias("user"), F.concat(F.lit("part "), "item").alias("item"), "rating"
    )
    found = factorise(ratings)
    predicted = found.predict(ratings.select("user", "item")).agg(F.count("prediction").alias("predicted"))
    better = (F.col("rmse") < F.col("stddev")).alias("better_than_the_mean")
    return found.report.crossJoin(predicted).select("ratings", "users", "items", "predicted", better)


@query(
    "anomaly_scores",
    """WITH priced AS (
         SELECT p_brand, l_orderkey, l_partkey, l_linenumber, l_extendedprice
         FROM lineitem JOIN part ON l_partkey = p_partkey),
       stats AS (
         SELECT p_brand, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s
         FROM priced GROUP BY p_brand)
       SELECT p_brand, l_orderkey, l_partkey, l_linenumber, l_extendedprice,
              round((l_extendedprice - m) / s, 4) + 0.0::DOUBLE AS score,
              abs((l_extendedprice - m) / s) > 1.5 AS anomaly
       FROM priced JOIN stats USING (p_brand)""",
)
def _anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    priced = (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select("p_brand", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    )
    # read once for the statistics and once for the rows
    scored = anomaly_scores(checkpoint(priced), "p_brand", "l_extendedprice", threshold=1.5)
    return scored.withColumn("score", F.round("score", 4))
