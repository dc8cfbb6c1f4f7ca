"""Streams over several batches, restarts and repeated batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.operators.logs import Route
from tallymill.plans.streams import _in_batches
from tallymill.session import input_bytes, spread
from tallymill.streaming import jobs
from tallymill.streaming.history import current_history, stream_history
from tests.fixtures import RECORDS


def write(folder, name, text):
    Path(folder).mkdir(exist_ok=True)
    Path(folder, name).write_text(text)


def counts(df):
    return {r.word: r["count"] for r in df.collect()}


def test_word_counts_per_batch_and_in_total(spark, folder):
    source = folder + "/in"
    write(source, "1", "a b\na\n")

    def run():
        for start, path in ((jobs.stream_word_counts, "each"), (jobs.stream_word_totals, "all")):
            lines = jobs.text_stream(spark, source, files_per_batch=1)
            start(lines, f"{folder}/{path}", f"{folder}/{path}-c").awaitTermination()

    run()
    write(source, "2", "a c\n\n")
    write(source, "3", "d\n")
    run()
    each = jobs.batch_counts(spark, folder + "/each")
    per_batch = {b: counts(each.filter(F.col("batch") == b)) for b in (0, 1, 2)}
    assert per_batch == {0: {"a": 2, "b": 1}, 1: {"a": 1, "c": 1, "": 1}, 2: {"d": 1}} or per_batch == {
        0: {"a": 2, "b": 1}, 1: {"d": 1}, 2: {"a": 1, "c": 1, "": 1}}
    assert counts(jobs.word_totals(spark, folder + "/all")) == {"a": 3, "b": 1, "c": 1, "": 1, "d": 1}


ROUTES = [Route("driver", "spark", cluster="c", pod_suffix="-driver"), Route("silent", "x")]


def test_log_aggregation(spark, folder):
    source = folder + "/in"
    schema = "raw string, cluster string, pod string, container string"
    for n in range(2):
        rows = [(raw, "c", "p-driver" if n else "p-exec-1", "spark") for raw in RECORDS]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    jobs.stream_logs(stream, ROUTES, folder + "/out", folder + "/c").awaitTermination()
    routed = jobs.routed_events(spark, folder + "/out").collect()
    assert sorted(r.message for r in routed) == ["after the broken one", "all tags", "no instant"]
    assert {r.route for r in routed} == {"driver"}
    assert jobs.violations(spark, folder + "/out").count() == 0


def files(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_phases_follow_the_events(spark, folder):
    schema = "app string, id long, phase string"
    source, out = folder + "/in", folder + "/out"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.stream_phases(stream, "app", ["id"], out, folder + "/c").awaitTermination()
        found = jobs.current_phases(spark, out, "app", ["id"], schema)
        return {r.app: (r.phase, r.terminal) for r in found.collect()}

    files(spark, source, [("a", 1, "Running"), ("b", 1, "Running")], schema)
    assert run() == {"a": ("Running", False), "b": ("Running", False)}
    # A late event does not take the phase back.
    files(spark, source, [("a", 5, "Succeeded"), ("b", 0, "Pending")], schema)
    files(spark, source, [("a", 4, "Running")], schema)
    assert run() == {"a": ("Succeeded", True), "b": ("Running", False)}


SCHEMA = "app string, id long"


def once(spark, folder, checkpoint, act=None):
    stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
    jobs.stream_once(
        stream, "app", ["id"], folder + "/out", f"{folder}/{checkpoint}", act
    ).awaitTermination()
    found = jobs.processed(spark, folder + "/out", SCHEMA)
    return sorted((r.app, r.id) for r in found.collect())


def test_a_key_is_processed_once(spark, folder):
    files(spark, folder + "/in", [("a", 2), ("a", 1), ("b", 7)], SCHEMA)
    assert once(spark, folder, "c") == [("a", 1), ("b", 7)]
    files(spark, folder + "/in", [("a", 0), ("c", 3)], SCHEMA)
    assert once(spark, folder, "c") == [("a", 1), ("b", 7), ("c", 3)]
    # Another stream over the same input finds everything in the ledger.
    assert once(spark, folder, "other") == [("a", 1), ("b", 7), ("c", 3)]


def test_a_lost_batch_is_repeated_without_duplicates(spark, folder):
    """The stream dies after it has acted and before the ledger has the keys."""
    files(spark, folder + "/in", [("a", 1), ("b", 7)], SCHEMA)
    write_batch, calls = jobs.write_batch, []

    def dying(df, path, batch_id, partition_by=()):
        if "/ledger/" in path and not calls:
            calls.append(path)
            raise RuntimeError("lost")
        write_batch(df, path, batch_id, partition_by)

    jobs.write_batch = dying
    try:
        with pytest.raises(Exception, match="lost"):
            once(spark, folder, "c")
        assert once(spark, folder, "c") == [("a", 1), ("b", 7)]
    finally:
        jobs.write_batch = write_batch
    assert once(spark, folder, "c") == [("a", 1), ("b", 7)]


def test_action_result_is_what_counts(spark, folder):
    files(spark, folder + "/in", [("a", 1), ("b", 7)], SCHEMA)
    refused = lambda df, _: df.filter("app <> 'b'")
    assert once(spark, folder, "c", refused) == [("a", 1)]
    # A key the action has not taken is tried again with its next event.
    files(spark, folder + "/in", [("b", 9)], SCHEMA)
    assert once(spark, folder, "c") == [("a", 1), ("b", 9)]


def test_history_is_bounded(spark, folder):
    schema = "test_name string, id long, duration double"
    source, out = folder + "/in", folder + "/out"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        stream_history(stream, "test_name", ["id"], out, folder + "/c", n=3).awaitTermination()
        found = {}
        for r in current_history(spark, out, "test_name", schema, ["id"], 3).collect():
            found.setdefault(r.test_name, []).append(r.id)
        return {key: sorted(ids) for key, ids in found.items()}

    hot = [("hot", i, 40.0 if i % 2 else 10.0) for i in range(2000)]
    files(spark, source, hot + [("a", 1, 30.0), ("short", 1, 29.9)], schema)
    assert run() == {"hot": [1995, 1997, 1999], "a": [1]}
    files(spark, source, [("hot", 1996, 50.0), ("a", 3, 31.0), ("a", 2, 1.0)], schema)
    assert run() == {"hot": [1996, 1997, 1999], "a": [1, 3]}
    # a batch keeps three runs of a key, however many it has
    kept = jobs.read_batches(spark, out, schema).groupBy("batch", "test_name").count()
    assert kept.agg(F.max("count")).first()[0] == 3


def test_history_keeps_null_keys_and_exact_orders(spark, folder):
    schema = "test_name string, id long, duration double"
    source, out = folder + "/in", folder + "/out"
    big = 9007199254740993
    for rows in ([(None, big, 40.0), (None, None, 41.0), ("a", None, 42.0)], [(None, big - 2, 43.0), ("b", 1, 44.0)]):
        files(spark, source, rows, schema)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_history(stream, "test_name", ["id"], out, folder + "/c", n=2).awaitTermination()
    found = {tuple(r) for r in current_history(spark, out, "test_name", schema, ["id"], 2).collect()}
    assert found == {(None, big, 40.0), (None, big - 2, 43.0), ("a", None, 42.0), ("b", 1, 44.0)}


def test_ingest_survives_a_restart(spark, folder):
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS ingest LOCATION '{folder}/ingest'")
    for rows in ([("a", 1)], [("b", 2)]):
        files(spark, folder + "/in", rows, SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
        jobs.stream_to_table(stream, "ingest.t", folder + "/c").awaitTermination()
    assert sorted(map(tuple, spark.table("ingest.t").collect())) == [("a", 1), ("b", 2)]
    spark.sql("DROP SCHEMA ingest CASCADE")


def test_parts_grow_with_the_files(spark, folder):
    cores = spark.sparkContext.defaultParallelism
    for i in range(2):
        spark.range(20_000).write.parquet(f"{folder}/{i}")
        df = spark.read.parquet(f"{folder}/{i}")
        held = sum(p.stat().st_size for p in Path(f"{folder}/{i}").glob("*.parquet"))
        assert input_bytes(df) == held
        assert spread(df.coalesce(1)).rdd.getNumPartitions() == cores
        assert spread(df.coalesce(1), 8).rdd.getNumPartitions() == 8
        scanned = df.rdd.getNumPartitions()
        assert spread(df, 8).rdd.getNumPartitions() == max(cores, 8 * scanned)


def test_a_log_batch_is_kept_in_bounded_parts(spark, folder, monkeypatch):
    parts = []
    keep = jobs.log_events
    monkeypatch.setattr(jobs, "log_events", lambda df, *args: parts.append(df.rdd.getNumPartitions()) or keep(df, *args))
    schema = "raw string, cluster string, pod string, container string"
    rows = [(raw, "c", "p-driver", "spark") for raw in RECORDS]
    spark.createDataFrame(rows * 20, schema).coalesce(1).write.json(folder + "/in")
    stream = spark.readStream.schema(schema).json(folder + "/in")
    jobs.stream_logs(stream, ROUTES, folder + "/out", folder + "/c").awaitTermination()
    assert parts[0] > spark.sparkContext.defaultParallelism
    assert jobs.routed_events(spark, folder + "/out").count() == 20 * 3


def test_batches_have_files_for_all_cores(spark, folder):
    spark.range(1_000).write.parquet(folder + "/table")
    rows = spark.read.parquet(folder + "/table")
    stream = _in_batches(rows, folder + "/in", 4)
    found = []
    name = F.col("_metadata.file_path")
    stream.select("id", name.alias("file")).writeStream.foreachBatch(
        lambda df, i: found.append((df.select("file").distinct().count(), df.count()))
    ).option("checkpointLocation", folder + "/c").trigger(availableNow=True).start().awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert [n for n, _ in found] == [cores] * 4 and sum(n for _, n in found) == 1_000
