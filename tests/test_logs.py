import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.functions.text import instant_timestamp
from tallymill.operators.logs import (
    Route,
    count_per_route,
    invariant_violations,
    level_filter,
    log_events,
    route,
    routes_table,
    silent_routes,
    valid_events,
)
from tallymill.plans.rendered import default_routes
from tallymill.sources.logs import (
    parse_pattern_log,
    read_log4j_xml,
    read_pattern_log,
    read_prometheus,
)

from tests.fixtures import RECORDS


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "prepared.xml"
    path.write_text("\n\n".join(RECORDS) + "\n")
    raw = read_log4j_xml(spark, str(path))
    assert raw.count() == 14
    fixed = F.timestamp_seconds(F.lit(1_800_000_000))
    return log_events(raw, fixed).orderBy(F.monotonically_increasing_id()).cache()


def test_one_reason_per_faulty_record(events):
    errors = [row.errors for row in events.collect()]
    assert errors == [
        None,
        None,
        ["missing epochSecond"],
        ["missing nanoOfSecond"],
        ["invalid epochSecond"],
        ["missing timestamp"],
        ["invalid timeMillis"],
        ["missing logger"],
        ["missing level"],
        ["unknown level"],
        ["missing message"],
        ["wrong root tag"],
        ["unparsable record"],
        None,
    ]


def test_valid_events(events):
    texts = [row.message for row in valid_events(events).collect()]
    assert texts == ["all tags", "no instant", "after the broken one"]


def test_fields_of_a_full_record(events):
    row = events.first()
    assert row.timestamp == datetime(2023, 12, 31, 23, 0) and row.nano == 0
    assert (row.level, row.logger, row.thread) == ("INFO", "TestLogger", "main")
    assert row.thrown.name == "TestException" and row.thrown.message == "test message"
    assert [(f.method, f.line, f.exact) for f in row.thrown.frames] == [
        ("m1", 123, False),
        ("m2", 456, True),
    ]


def test_faulty_events_keep_the_invariant(events):
    assert invariant_violations(events).count() == 0
    broken = events.collect()[12]
    assert broken.level == "INFO" and broken.logger == "" and "Invalid tag" in broken.message


def test_nanoseconds_are_cut_to_micros(spark):
    df = spark.range(1).select(instant_timestamp(F.lit("1"), F.lit("1999")).alias("t"))
    assert df.first().t.microsecond == 1


def test_invariant_looks_at_all_events(spark):
    df = spark.createDataFrame(
        [(datetime(1970, 1, 1), "INFO", "a", "m"), (datetime(2024, 1, 1), None, "a", "m"),
         (datetime(2024, 1, 1), "INFO", "a", "m")],
        "timestamp timestamp, level string, logger string, message string",
    )
    assert invariant_violations(df).count() == 2


def test_default_routes():
    routes = default_routes()
    assert len(routes) == 28 and len({r.route for r in routes}) == 28


@pytest.fixture
def pods(spark):
    return spark.createDataFrame(
        [("c1", "job-1-driver", "spark"), ("c1", "job-1-exec-1", "spark"),
         ("c1", "job-1-exec-11", "spark"), ("c2", "job-1-driver", "spark"),
         ("c2", "exact", "vector")],
        "cluster string, pod string, container string",
    )


ROUTES = [
    Route("driver", "spark", cluster="c1", pod_suffix="-driver"),
    Route("first", "spark", cluster="c1", pod_suffix="-exec-1"),
    Route("any", "spark", cluster="c1"),
    Route("pod", "vector", pod="exact"),
    Route("silent", "vector", pod="other"),
]


@pytest.mark.parametrize("as_table", [False, True])
def test_routes(spark, pods, as_table):
    routes = routes_table(spark, ROUTES) if as_table else ROUTES
    found = {(r.route, r.pod) for r in route(pods, routes).collect()}
    assert found == {
        ("driver", "job-1-driver"), ("first", "job-1-exec-1"), ("pod", "exact"),
        ("any", "job-1-driver"), ("any", "job-1-exec-1"), ("any", "job-1-exec-11"),
    }
    counts = {r.route: r.events for r in count_per_route(pods, routes).collect()}
    assert counts == {"driver": 1, "first": 1, "any": 3, "pod": 1, "silent": 0}
    assert [r.route for r in silent_routes(pods, routes).collect()] == ["silent"]


def test_routing_is_one_broadcast_join(pods):
    plan = route(pods, ROUTES)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_do_not_repeat_the_parser(spark):
    df = valid_events(log_events(spark.createDataFrame([(RECORDS[0],)], "raw string")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_level_filter(spark):
    rows = [("a", "INFO"), ("a", "DEBUG"), ("org.x", "WARN"), ("org.x.y", "INFO"),
            ("org.x.y", "ERROR"), ("org.xy", "INFO"), ("off", "FATAL"), ("a", "nonsense")]
    df = spark.createDataFrame(rows, "logger string, level string")
    thresholds = {"ROOT": "INFO", "org.x": "WARN", "org.x.y": "ERROR", "off": "OFF"}
    kept = {tuple(r) for r in level_filter(df, thresholds).collect()}
    assert kept == {("a", "INFO"), ("org.x", "WARN"), ("org.x.y", "ERROR"), ("org.xy", "INFO")}


def test_pattern_log(spark, tmp_path):
    (tmp_path / "log").write_text(
        "2024-01-02T03:04:05,678 INFO [main [x]] a.B - started - ok\n\tat a.B(line)\n"
    )
    (row,) = read_pattern_log(spark, str(tmp_path)).collect()
    assert row[:5] == (
        datetime(2024, 1, 2, 3, 4, 5, 678000), "INFO", "main [x]", "a.B", "started - ok\n\tat a.B(line)",
    )


def test_pattern_log_with_line_breaks_in_a_value(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\ne\nf",)], "value string")
    assert parse_pattern_log(df).first()[:5] == (None,) * 5


def test_prometheus(spark, tmp_path):
    (tmp_path / "scrape").write_text(
        '# HELP x y\nmetrics_executor_memoryUsed_bytes{application_id="a,b", executor_id="1"} 3.5\n'
        "jmx_scrape_error 0.0\nnan_value NaN\ninf_value +Inf 1395066363000\n\nnot a metric line\n"
    )
    rows = {r.name: r for r in read_prometheus(spark, str(tmp_path)).collect()}
    first = rows["metrics_executor_memoryUsed_bytes"]
    assert first.labels == {"application_id": "a,b", "executor_id": "1"} and first.value == 3.5
    assert first.endpoint == "scrape"
    assert rows["jmx_scrape_error"].labels == {} and rows["jmx_scrape_error"].value == 0.0
    assert rows["jmx_scrape_error"].raw is None and rows[None].raw == "not a metric line"
    assert rows["inf_value"].value == float("inf") and rows["nan_value"].value != 0


@pytest.mark.parametrize("between", ["\n", "\r\n", "\r\n\r\n", "\n\n", ""])
def test_no_record_is_lost(spark, tmp_path, between):
    records = [
        f'<Event timeMillis="{i}" level="INFO" loggerName="a"><Message>one\n\ntwo {i}</Message></Event>'
        for i in range(100)
    ]
    path = tmp_path / "records.xml"
    path.write_bytes((between.join(records) + "\n").encode())
    assert sorted(r.raw for r in read_log4j_xml(spark, str(path)).collect()) == sorted(records)


def test_open_records_keep_their_neighbours(spark, tmp_path):
    good = '<Event timeMillis="1" level="INFO" loggerName="a"><Message>m</Message></Event>'
    path = tmp_path / "records.xml"
    path.write_text("\n".join([good, '<Event level="', good, "<NoEvent>x</NoEvent>", '<Event a="1"><Instant/></Event>', '<Event a="2"/>', good]))
    raw = sorted(r.raw for r in read_log4j_xml(spark, str(path)).collect())
    others = ['<Event level="', "<NoEvent>x</NoEvent>", '<Event a="1"><Instant/></Event>', '<Event a="2"/>']
    assert raw == sorted([good, good, good, *others])


def test_a_repeated_label_counts_once(spark, tmp_path):
    (tmp_path / "scrape.txt").write_text('m{a="1",b="x\\"y",a="2"} 3\nn 4\n')
    rows = {r.name: r for r in read_prometheus(spark, str(tmp_path)).collect()}
    assert rows["m"].labels == {"a": "2", "b": 'x"y'}
    assert rows["n"].value == 4 and not rows["n"].labels


HEAD = "2024-01-01T10:00:{:02d},000 ERROR [main] a.B - event {}"


def assembled(texts, longest):
    """What the lines of each file make up, one after the other."""
    out = []
    for text in texts:
        event = None
        for line in text.splitlines():
            if line.startswith("2024"):
                event = [line]
                out.append(event)
            elif event is not None and len(event) <= longest:
                event.append(line)
            else:
                out.append([line])
    return sorted("\n".join(e) for e in out)


@pytest.mark.parametrize("split", [97, 1000, 10**6])
def test_stack_traces_join_their_event(spark, folder, split):
    rnd = random.Random(split)
    texts = ["\tat nothing\nno head at all\n" * 30, "", "only one line", HEAD.format(1, "single")]
    for _ in range(6):
        lines = [f"early {i}" for i in range(rnd.choice([0, 0, 3]))]
        for i in range(rnd.randint(0, 25)):
            lines.append(HEAD.format(i, i))
            lines += [rnd.choice(["\tat A.b(A.java:1)", "Caused by: é", "", "  " * 40]) for _ in range(rnd.choice([0, 0, 0, 1, 3, 40]))]
        texts.append("\n".join(lines) + rnd.choice(["", "\n"]))
    Path(folder, "logs").mkdir()
    for n, text in enumerate(texts):
        Path(folder, "logs", f"{n}.log").write_text(text)
    names = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        events = read_pattern_log(spark, folder + "/logs").collect()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert sorted(e.value for e in events) == assembled(texts, 10**9)
    for e in events:
        if e.value.startswith("2024"):
            assert e.level == "ERROR" and e.message == e.value.split(" - ", 1)[1] and e.ts is not None
        else:
            assert (e.ts, e.level, e.message) == (None, None, None)


def test_an_endless_trace_is_cut_and_not_lost(spark, folder):
    text = "\n".join([HEAD.format(1, 1)] + [f"line {i}" for i in range(50)] + [HEAD.format(2, 2), "x"])
    Path(folder, "a.log").write_text(text)
    found = sorted(r.value for r in read_pattern_log(spark, folder + "/a.log", longest=7).collect())
    assert found == assembled([text], 7) and len(found) == 2 + 43
