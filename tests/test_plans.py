"""What reaches the scans, and what is shuffled."""

import re
from pathlib import Path

import __spark_entry__ as entry
from tallymill.__main__ import main
from tallymill.session import spread

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(text):
    return re.findall(r"ReadSchema: struct<(.*?)>", text)


def test_report_reads_its_four_columns(spark):
    text = plan(spark, "weekday_report")
    assert [len(s.split(",")) for s in scanned(text)] == [4]
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_threshold_reaches_the_scan(spark):
    assert "GreaterThanOrEqual(value,30.0)" in plan(spark, "long_runs")


def test_history_is_cut_on_both_sides_of_one_shuffle(spark):
    text = plan(spark, "run_history")
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_top_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "slowest_tests")


def test_no_query_pairs_everything(spark):
    for name in ("events_per_route", "missing_metrics", "resolved_layers", "anomaly_scores",
                 "merge_containers", "status_of_driver_events"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_large_tables_are_not_spread(spark):
    assert spread(spark.range(0, 10, 1, 64)).rdd.getNumPartitions() == 64
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 4


def test_report_job(spark, tmp_path, capfd):
    trips = tmp_path / "trips.csv"
    trips.write_text(
        "tpep_pickup_datetime,passenger_count,trip_distance,total_amount\n"
        "2024-01-07 10:00:00,2,3.0,10.0\n2024-01-07 11:00:00,1,5.0,20.0\n"
    )
    main(["-i", str(trips), "-o", str(tmp_path / "out")])
    (part,) = Path(tmp_path, "out").glob("part-*")
    lines = part.read_text().splitlines()
    header = "day_of_week,total_passengers,avg_trip_distance,avg_amount"
    assert lines == [header, "1,3,4.0,15.0"]
    assert "avg_amount" in capfd.readouterr().out
