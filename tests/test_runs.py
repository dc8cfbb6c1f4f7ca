import random
import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymill.functions import numeric
from tallymill.functions.quantities import cores, mib, usable_mib
from tallymill.operators.capacity import capacity_rollup
from tallymill.operators.runs import (
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


def quantities(spark, function, values, *more):
    df = spark.createDataFrame([(v,) for v in values], "q string")
    return [r[0] for r in df.select(function("q", *more)).collect()]


def test_cores(spark):
    given = ["1800m", "100m", "1.5", "2", "0", "-1", "x", "", None, "2000m", "2001m"]
    assert quantities(spark, cores, given) == [2, 1, 2, 2, 0, 0, None, None, None, 2, 3]


def test_mib(spark):
    given = ["128Mi", "1.5Gi", "1Ti", "1048576Ki", "1048576", "1G", "1Xi", "Mi", None]
    expected = [128, 1536, 1048576, 1024, 1, 953, None, None, None]
    assert quantities(spark, mib, given) == expected


@pytest.mark.parametrize(
    "quantity, jvm, expected",
    [("512Mi", True, 128), ("128Mi", True, 128), ("1024Mi", True, 640), ("384Mi", True, 0),
     ("383Mi", False, 383), ("8Gi", True, 7447), ("8Gi", False, 5851), ("bad", True, None)],
)
def test_usable_memory(spark, quantity, jvm, expected):
    assert quantities(spark, usable_mib, [quantity], jvm) == [expected]


def test_capacity(spark):
    rows = [("a", "250m", "1024Mi", "2", "1024Mi", 3, True), ("a", "1", "512Mi", "1", "512Mi", None, True),
            ("b", "1", "128Mi", "1500m", "8Gi", 1, False)]
    schema = ("team string, driver_cpu string, driver_memory string, executor_cpu string, "
              "executor_memory string, replicas int, jvm boolean")
    found = {r.team: (r.apps, r.cores, r.memory_mib)
             for r in capacity_rollup(spark.createDataFrame(rows, schema), "team").collect()}
    assert found == {"a": (2, 8, 2688), "b": (1, 3, 5979), "total": (3, 11, 8667)}


def test_run_ids(spark):
    text = ("x\nCreating namespace: kuttl-test-one\n--- FAIL: kuttl/harness/smoke_a (2s)\n"
            "Creating namespace: kuttl-test-two\n--- FAIL: kuttl/harness/smoke_b\n"
            "failed in step 10-assert\nfailed in step 20-x")
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    rows = {r.id: r for r in extract_run_ids(df).collect()}
    assert rows[1].namespace == "kuttl-test-one"
    assert rows[1].failed_tests == ["smoke_a", "smoke_b"]
    assert rows[1].failed_step == "failed in step 10-assert"
    assert rows[2].namespace is None and rows[2].failed_tests == []
    assert rows[2].failed_step == "Could not find failed step"


START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """One key with a third of all rows, one with short runs only, some small ones."""
    rng = random.Random(1)
    rows = [("hot", i, round(rng.uniform(1, 200), 2)) for i in range(400)]
    rows += [(f"k{i % 20}", i, round(rng.uniform(1, 200), 2)) for i in range(780)]
    rows += [("short", i, 29.99) for i in range(20)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(
        [(k, START + timedelta(minutes=i // 3), i, d) for k, i, d in rows],
        "test_name string, ts timestamp, id long, duration double",
    ).repartition(7)


def kept_by_hand(rows, n=50):
    kept = {}
    for key, _, duration in sorted(rows, key=lambda r: r[1]):
        if duration >= 30.0:
            kept.setdefault(key, []).append(duration)
    return {key: values[-n:] for key, values in kept.items()}


@pytest.mark.parametrize("n", [1, 50, 1500])
def test_last_n(history, n):
    rows, df = history
    found = {}
    for row in last_n(min_duration(df), "test_name", ["ts", "id"], n).collect():
        found.setdefault(row.test_name, []).append(row.duration)
    expected = kept_by_hand(rows, n)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_last_n_is_cut_before_the_shuffle(history):
    plan = last_n(history[1], "test_name", ["ts", "id"])._jdf.queryExecution().executedPlan()
    assert "WindowGroupLimit" in plan.toString()


def test_duration_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(30.0,), (29.99,), (None,)], "duration double")
    assert [r.duration for r in min_duration(df).collect()] == [30.0]


def test_runtime_stats(history):
    rows, df = history
    found = {r.test_name: r for r in runtime_stats(df, order=["ts", "id"], digits=2).collect()}
    expected = kept_by_hand(rows)
    assert set(found) == set(expected) | {"short"}
    for key, values in expected.items():
        row = found[key]
        assert row.mean == pytest.approx(statistics.mean(values))
        assert row["median"] == pytest.approx(statistics.median(values))
        assert (row.min, row["max"], row.runs) == (min(values), max(values), len(values))
    assert found["short"][1:] == (0.0, 0.0, 0.0, 0.0, 0)


def test_overall_and_extremes(history):
    rows, df = history
    kept = kept_by_hand(rows)
    values = [v for part in kept.values() for v in part]
    row = overall_runtime(last_n(min_duration(df), "test_name", ["ts", "id"])).first()
    assert row.runs == len(values) and row.mean == pytest.approx(statistics.mean(values))
    assert row["median"] == pytest.approx(statistics.median(values))
    assert (row.fastest, row.slowest) == (min(values), max(values))
    stats = runtime_stats(df, order=["ts", "id"]).filter("runs > 0")
    order = sorted(kept, key=lambda k: -statistics.mean(kept[k]))
    assert [r.test_name for r in top_slowest(stats).collect()] == order[:3]
    assert [r.test_name for r in top_fastest(stats).collect()] == order[::-1][:3]


def test_overall_of_nothing(spark):
    row = overall_runtime(spark.createDataFrame([], "duration double")).first()
    assert row.runs == 0 and row["median"] is None and row.mean is None


@pytest.mark.parametrize("shape", ["even", "ties", "two", "tail", "small"])
def test_median_over_many_rounds(spark, monkeypatch, shape):
    monkeypatch.setattr(numeric, "MEDIAN_TAIL_VALUES", 5)
    rng = random.Random(7)
    values = {
        "even": [rng.random() for _ in range(5000)],
        "ties": [float(rng.choice([1, 1, 1, 1, 2, 3] + list(range(900)))) for _ in range(4001)],
        "two": [1.0] * 500 + [2.0] * 500,
        "tail": [10.0 ** rng.randint(-300, 300) for _ in range(3000)],
        "small": [3.0, -1.0],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert numeric.exact_median(df, "v") == statistics.median(values)


BIG = 9007199254740993  # no double has this value


@pytest.mark.parametrize("values", [
    [BIG], [BIG, BIG + 2], [BIG, BIG + 1], [-(2**63), 2**63 - 1, BIG], [BIG + i for i in range(301)],
    [(i * 7919 % 1009) ** 6 for i in range(1009)] + [BIG] * 900,
])
def test_median_of_whole_numbers_is_exact(spark, monkeypatch, values):
    monkeypatch.setattr(numeric, "MEDIAN_TAIL_VALUES", 5)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    assert numeric.exact_median(df, "v") == statistics.median(map(Decimal, values))
    row = overall_runtime(df, "v").first()
    assert (row.runs, row.fastest, row.slowest) == (len(values), min(values), max(values))
    assert row["median"] == statistics.median(map(Decimal, values))


def test_median_of_decimals_that_are_one_double(spark, monkeypatch):
    """All values lie between two neighbouring doubles, so only even cuts tell them apart."""
    monkeypatch.setattr(numeric, "MEDIAN_TAIL_VALUES", 5)
    base = "123456789012345678901234567."
    values = [Decimal(f"{base}{i:010d}") for i in range(1200)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(38,10)").repartition(3)
    assert numeric.exact_median(df, "v") == Decimal(f"{base}00000005995")
    assert numeric.exact_median(df.where(F.col("v") != values[0]), "v") == values[600]


def test_last_runs_with_maps_beyond_the_limit_of_a_window(spark):
    rows = [("a", i, {"k": i}) for i in range(3000)]
    df = spark.createDataFrame(rows, "test_name string, id long, tags map<string,int>").repartition(4)
    kept = last_n(df, "test_name", ["id"], 1500).collect()
    assert sorted(r.id for r in kept) == list(range(1500, 3000)) and all(r.tags == {"k": r.id} for r in kept)


def test_mean_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007 / 100).alias("v"))
    means = {df.repartition(n).agg(numeric.mean("v", 2)).first()[0] for n in (1, 3, 8)}
    assert len(means) == 1
    assert df.filter("v < 0").agg(numeric.mean("v", 2)).first()[0] is None


def test_outcomes(spark):
    rows = [
        ("ok", 1, True, "n1", None),
        ("flaky", 1, False, "n1", "s1"), ("flaky", 2, False, "n2", "s2"), ("flaky", 3, True, "n3", None),
        ("bad", 1, False, "n1", "s1"), ("bad", 2, False, "n2", "s2"), ("bad", 3, False, None, "s3"),
        ("once", 1, False, "n1", "s1"),
        ("quiet", 1, False, "n1", "s1"), ("quiet", 2, False, None, None),
        ("regressed", 1, True, "n1", None), ("regressed", 2, False, "n2", "s2"),
    ]
    df = spark.createDataFrame(
        rows, "test_name string, attempt int, success boolean, namespace string, failed_step string"
    ).repartition(5)
    summary = classify_outcome(df)
    assert {r.test_name: tuple(r)[1:] for r in summary.collect()} == {
        "ok": ("passed", 1, None, None),
        "flaky": ("flaky", 3, None, None),
        "bad": ("failed", 3, "s3", "n2"),
        "once": ("failed", 1, None, None),
        "quiet": ("failed", 2, None, None),
        "regressed": ("passed", 2, None, None),
    }
    assert tuple(outcome_totals(summary).first()) == (6, 2, 1, 3, 50.0)
    assert tuple(outcome_totals(summary.filter("false")).first()) == (0, 0, 0, 0, 0.0)
