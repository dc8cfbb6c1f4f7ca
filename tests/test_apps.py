from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymill.operators.apps import (
    PHASES,
    attach_status,
    expired_applications,
    latest_phase,
    list_applications,
    metric_present,
    not_yet_processed,
    orphans,
)
from tallymill.operators.reports import anomaly_scores, monthly_stats, weekday_report, word_count
from tallymill.functions.blocks import unpacked
from tallymill.sources.logs import parse_prometheus, read_event_log


def test_latest_phase(spark):
    rows = [("a", 1, 1, "Running"), ("a", 2, 2, "Succeeded"), ("a", 2, 1, "Running"),
            ("b", 1, 1, "Failed"), ("b", 2, 1, None), ("c", 1, 1, None), ("d", 3, 1, "Running")]
    df = spark.createDataFrame(rows, "app string, ts int, id int, phase string").repartition(4)
    found = {r.app: (r.phase, r.terminal) for r in latest_phase(df, "app", ["ts", "id"]).collect()}
    assert found == {"a": ("Succeeded", True), "b": ("Failed", True), "c": ("Unknown", False),
                     "d": ("Running", False)}


def test_listed_phases_are_hashed(spark):
    rows = [("a", 1, "Running"), ("a", 2, "Failed"), ("b", 2, None), ("c", 7, "Pending")]
    df = spark.createDataFrame(rows, "app string, ts int, phase string")
    listed = latest_phase(df, phases=PHASES)
    assert sorted(listed.collect()) == sorted(latest_phase(df).collect())
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan
    with pytest.raises(PySparkException, match="unknown phase Lost"):
        latest_phase(df.withColumn("phase", F.lit("Lost")), phases=PHASES).collect()


def test_once_only(spark):
    batch = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "app string")
    ledger = spark.createDataFrame([("a", "Unknown"), ("a", ""), ("b", ""), ("b", None)],
                                   "app string, phase string")
    assert sorted(r.app for r in not_yet_processed(batch, ledger, "app").collect()) == ["b", "c", "c"]


def test_status_and_orphans(spark):
    events = spark.createDataFrame([("n", "a", 1), ("n", "x", 2), ("m", "a", 3)],
                                   "namespace string, app string, id int")
    apps = spark.createDataFrame([("n", "a", "ref")], "namespace string, app string, ref string")
    on = ["namespace", "app"]
    assert [(r.id, r.ref) for r in attach_status(events, apps, on).collect()] == [(1, "ref")]
    assert sorted(r.id for r in orphans(events, apps, on).collect()) == [2, 3]


def start(app, ms):
    return ('{"Event":"SparkListenerApplicationStart","App Name":"n","App ID":"%s",'
            '"Timestamp":%d,"User":"u"}' % (app, ms))


END = '{"Event":"SparkListenerApplicationEnd","Timestamp":%d}'


@pytest.fixture
def logs(tmp_path):
    rolling = tmp_path / "eventlog_v2_app-1"
    rolling.mkdir()
    (rolling / "appstatus_app-1").write_text("")
    (rolling / "events_1_app-1").write_text(
        '{"Event":"SparkListenerLogStart","Spark Version":"4.1.2"}\n' + start("app-1", 1000) + "\n"
    )
    # The end is in a later file of the same log; a job may mention any text.
    (rolling / "events_2_app-1").write_text(
        '{"Event":"SparkListenerJobStart","x":"\\"Event\\":\\"SparkListenerApplicationEnd\\""}\n'
        + END % 5000 + "\n"
    )
    (tmp_path / "app-2.inprogress").write_text(start("app-2", 2000) + "\n")
    (tmp_path / "app-3").write_text('{"Event":"SparkListenerLogStart"}\n')
    return str(tmp_path)


def test_event_logs(spark, logs):
    apps = {r.log: r for r in list_applications(read_event_log(spark, logs)).collect()}
    assert set(apps) == {"app-1", "app-2"}
    one, two = apps["app-1"], apps["app-2"]
    assert (one.app_id, one.app_name, one.user) == ("app-1", "n", "u")
    assert (one.start_ms, one.end_ms, one.duration_ms, one.completed) == (1000, 5000, 4000, True)
    assert (two.end_ms, two.completed) == (None, False)


def test_real_event_log(spark, tmp_path):
    """A log that Spark itself has written, compressed and rolling."""
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        "s = (SparkSession.builder.master('local[1]').appName('real')"
        ".config('spark.ui.enabled', 'false').config('spark.eventLog.enabled', 'true')"
        f".config('spark.eventLog.dir', 'file://{tmp_path}').getOrCreate())\n"
        "s.range(5).count(); s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    apps = list_applications(read_event_log(spark, str(tmp_path))).collect()
    assert len(apps) == 1
    assert apps[0].app_name == "real" and apps[0].completed and apps[0].log == apps[0].app_id


@pytest.mark.parametrize("codec", ["lz4", "snappy", "lzf"])
def test_block_framed_event_logs(spark, tmp_path, codec):
    """What Spark's own codec has written, whole and cut off in the middle of a block."""
    kind = {"lz4": "LZ4", "snappy": "Snappy", "lzf": "LZF"}[codec]
    jvm = spark._jvm
    lines = [start("app-1", 1000)] + ['{"Event":"SparkListenerJobStart","Job ID":%d,"é":"%s"}' % (i, "x" * (i % 50)) for i in range(9000)]
    lines.append(END % 5000)
    conf = jvm.org.apache.spark.SparkConf()
    writer = getattr(jvm.org.apache.spark.io, f"{kind}CompressionCodec")(conf)
    raw = jvm.java.io.ByteArrayOutputStream()
    out = writer.compressedOutputStream(raw)
    out.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
    out.close()
    data = bytes(raw.toByteArray())
    assert unpacked(data, codec).decode().splitlines() == lines
    assert unpacked(data + data, codec).decode().splitlines() == 2 * lines
    begun = unpacked(data[: len(data) // 2], codec)
    assert begun and "".join(f"{line}\n" for line in lines).encode().startswith(begun)
    assert unpacked(b"", codec) == b""
    (tmp_path / f"app-1.{codec}").write_bytes(data)
    (tmp_path / f"app-2.{codec}.inprogress").write_text(start("app-2", 2000) + "\n")
    (tmp_path / f"empty.{codec}").write_bytes(b"")
    log = read_event_log(spark, str(tmp_path))
    assert log.where("log = 'app-1'").count() == len(lines)
    apps = {r.log: (r.start_ms, r.end_ms) for r in list_applications(log).collect()}
    assert apps["app-1"] == (1000, 5000)


def test_compacted_rolling_logs(spark, tmp_path):
    def write(app, name, *lines):
        folder = tmp_path / f"eventlog_v2_{app}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("".join(f"{line}\n" for line in lines))

    write("a", "events_1_a", start("a", 1), '{"Event":"old"}')
    write("a", "events_2_a", '{"Event":"old"}')
    write("a", "events_2_a.compact", start("a", 1))
    write("a", "events_3_a", '{"Event":"new"}')
    write("a", "events_10_a", END % 9)
    # an earlier compaction whose files are not gone yet
    write("b", "events_1_b.compact", start("b", 1), '{"Event":"old"}')
    write("b", "events_2_b", '{"Event":"old"}')
    write("b", "events_11_b.compact", start("b", 1), '{"Event":"kept"}')
    write("b", "events_12_b.compact.x", '{"Event":"no rolled file"}')
    write("c", "events_1_c", start("c", 1))
    log = read_event_log(spark, str(tmp_path))
    found = {}
    for r in log.collect():
        found.setdefault(r.log, []).append(r.event)
    assert sorted(found["a"]) == ["SparkListenerApplicationEnd", "SparkListenerApplicationStart", "new"]
    assert sorted(found["b"]) == ["SparkListenerApplicationStart", "kept", "no rolled file"]
    assert {r.log: r.end_ms for r in list_applications(log).collect()} == {"a": 9, "b": None, "c": None}
    assert expired_applications(log, 0, F.lit(datetime(2100, 1, 1))).count() == 3


def test_expired(spark, logs):
    log = read_event_log(spark, logs)
    later = F.lit(datetime(2100, 1, 1))
    day = 24 * 3600 * 1000
    assert {r.log for r in expired_applications(log, day, later).collect()} == {"app-1", "app-2"}
    assert expired_applications(log, day, F.current_timestamp()).count() == 0


def test_missing_metrics(spark):
    lines = [("server", "BlockManager_memory_remainingOnHeapMem_MB_Value 5"),
             ("executors", 'metrics_executor_memoryUsed_bytes{id="1"} 7')]
    samples = parse_prometheus(spark.createDataFrame(lines, "endpoint string, value string"))
    expected = spark.createDataFrame(
        [("server", "remainingOnHeapMem_MB"), ("executors", "remainingOnHeapMem_MB"),
         ("history", "jmx_scrape_error")], "endpoint string, metric string")
    missing = metric_present(samples, expected)
    assert sorted(r.endpoint for r in missing.collect()) == ["executors", "history"]
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_weekday_report_skips_missing_values(spark):
    trips = spark.createDataFrame(
        [(datetime(2024, 1, 7), 1, 2.5, 10.0), (datetime(2024, 1, 7), None, 3.5, 20.0),
         (datetime(2024, 1, 13), 2, None, 5.0)],
        "tpep_pickup_datetime timestamp, passenger_count int, trip_distance double, total_amount double",
    )
    for digits in (None, 2):
        rows = [tuple(r) for r in weekday_report(trips, digits).collect()]
        assert rows == [(1, 1, 3.0, 15.0), (7, 2, None, 5.0)]


def test_months_fold_over_years(spark):
    df = spark.createDataFrame([("2021-03-01", 1), ("2022-03-31", 4), ("2021-01-01", 7)],
                               "date_field string, int_field int")
    assert [tuple(r) for r in monthly_stats(df).collect()] == [(1, 1, 7.0, 7, 7), (3, 2, 2.5, 1, 4)]


def test_word_count_keeps_empty_words(spark):
    df = spark.createDataFrame([("a  b",), ("",), ("a",)], "value string")
    assert {r.word: r["count"] for r in word_count(df).collect()} == {"a": 2, "": 2, "b": 1}


def test_scores_of_hot_and_constant_groups(spark):
    rows = [("hot", float(i % 10)) for i in range(300)] + [("hot", 1000.0), ("flat", 5.0), ("flat", 5.0)]
    scored = anomaly_scores(spark.createDataFrame(rows, "g string, v double"), "g", "v")
    found = scored.collect()
    assert len(found) == len(rows)
    assert [(r.v) for r in found if r.anomaly] == [1000.0]
    assert {r.score for r in found if r.g == "flat"} == {None}
