"""Dense numbers of keys, factors under the keys that ratings have, and points from large indexes."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tallymill.operators import recommend
from tallymill.operators.numbering import dense_ids
from tallymill.operators.recommend import factorise
from tallymill.operators.reports import CIRCLE, STEP_X, STEP_Y, estimate_pi


@pytest.mark.parametrize("kind, keys", [
    ("long", [3_000_000_000, -5, 0, 7, 2**62, -(2**63)]),
    ("string", ["b", "", "a", "é", "東", "aa"]),
    ("timestamp_ntz", []),
])
def test_dense_ids(spark, kind, keys):
    rows = [(k,) for k in keys for _ in range(3)] + [(None,)]
    df = spark.createDataFrame(rows, f"`key` {kind}").repartition(4)
    found = {r.key: r.id for r in dense_ids(df, "key").collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}


def test_dense_ids_over_many_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011 * 1_000_003).alias("key")).repartition(7)
    numbered = dense_ids(df, "key")
    assert numbered.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first() == (0, 19_999, 20_000)
    pairs = sorted((r.key, r.id) for r in numbered.collect())
    assert [i for _, i in pairs] == list(range(20_000))


def test_factors_of_any_keys(spark):
    rows = [(3_000_000_000 + u, f"item {i}", float(1 + (u % 3) * (i % 4))) for u in range(12) for i in range(9) if (u + i) % 5]
    rows += [(None, "item 1", 2.0), (3_000_000_001, None, 2.0), (3_000_000_001, "item 1", None)]
    ratings = spark.createDataFrame(rows, "user long, item string, rating double")
    found = factorise(ratings, rank=3, iterations=8)
    report = found.report.first()
    assert (report.ratings, report.users, report.items) == (len(rows) - 3, 12, 9)
    assert report.rmse < report.stddev / 2
    pairs = [(3_000_000_000, "item 1", "x"), (3_000_000_005, "item 3", "y"), (1, "item 1", "z"), (3_000_000_000, "none", "w"), (None, None, "v")]
    predicted = found.predict(spark.createDataFrame(pairs, "user long, item string, note string"))
    assert predicted.columns == ["user", "item", "note", "prediction"]
    known = {r.note: r.prediction for r in predicted.collect()}
    assert known["x"] is not None and known["y"] is not None and {known[n] for n in "zwv"} == {None}
    assert sorted(r.user for r in found.factors("user").collect()) == [3_000_000_000 + u for u in range(12)]
    assert found.factors("item").columns == ["item", "features"]


def test_predictions_are_those_of_the_model(spark):
    rows = [(3_000_000_000 + u, f"item {i}", float(1 + (u % 3) * (i % 4))) for u in range(12) for i in range(9) if (u + i) % 5]
    found = factorise(spark.createDataFrame(rows, "user long, item string, rating double"), rank=3, iterations=4)
    pairs = spark.createDataFrame([r[:2] for r in rows] * 2 + [(1, "item 1"), (None, "item 2")], "user long, item string")
    numbered = pairs.join(found.users, "user").join(found.items, "item").select(
        "user", "item", F.col("user_id").cast("int"), F.col("item_id").cast("int")
    )
    expected = sorted(tuple(r) for r in found.model.transform(numbered).select("user", "item", "prediction").collect())
    predicted = found.predict(pairs)
    assert dict(predicted.dtypes)["prediction"] == "float"
    assert sorted(tuple(r) for r in predicted.where("prediction is not null").collect()) == expected
    assert predicted.count() == len(expected) + 2 == 2 * len(rows) + 2


def test_pairs_are_shuffled_once_for_each_side(spark, capsys):
    rows = [(u, f"item {i}", float(u + i)) for u in range(6) for i in range(5)]
    ratings = spark.createDataFrame(rows, "user long, item string, rating double")
    found = factorise(ratings, rank=2, iterations=1)
    pairs = ratings.select("user", "item", F.lit("x").alias("note")).where(F.rand() < 2)
    before = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for name, value in zip(before, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        found.predict(pairs.withColumn("note", F.concat("note", "item"))).explain("formatted")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert sum("note#" in columns for columns in moved) == 2


def test_blocks_of_ratings_are_bounded(spark, monkeypatch):
    rows = [(3_000_000_000 + u, f"item {i}", float(1 + (u % 3) * (i % 4))) for u in range(40) for i in range(9) if (u + i) % 5]
    ratings = spark.createDataFrame(rows, "user long, item string, rating double")
    for held, blocks in ((1_000, 10), (12, -(-len(rows) // 12))):
        monkeypatch.setattr(recommend, "BLOCK_RATINGS", held, raising=False)
        found = factorise(ratings, rank=3, iterations=4)
        assert found.model.userFactors.rdd.getNumPartitions() == found.model.itemFactors.rdd.getNumPartitions() == blocks
        report = found.report.first()
        assert (report.ratings, report.users, report.items) == (len(rows), 40, 9) and report.rmse < report.stddev / 2


@pytest.mark.parametrize("first", [0, 10**6, 10**15, 2**62])
def test_pi_from_any_index(spark, first):
    points = spark.range(20_000).select((F.col("id") + first).alias("id"))
    row = estimate_pi(points).first()
    inside = 0
    for i in range(first, first + 20_000):
        x, y = (i * step % CIRCLE / CIRCLE for step in (STEP_X, STEP_Y))
        inside += x * x + y * y <= 1
    assert (row.points, row.inside) == (20_000, inside) and abs(row.pi - math.pi) < 0.02


def test_pi_of_nothing_and_below_zero(spark):
    assert estimate_pi(spark.range(0)).first()["pi"] is None
    assert abs(estimate_pi(spark.range(-20_000, 0)).first()["pi"] - math.pi) < 0.02
