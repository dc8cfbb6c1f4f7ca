"""Merged batches: the same rows before, while and after, in few folders; and the ledger built on them."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.operators.apps import latest_phase
from tallymill.streaming import batches, jobs, ledger
from tallymill.streaming.history import current_history, stream_history

SCHEMA = "key string, n long"


def append(spark, path, batch_id, rows, every=3, merge=lambda rows: rows):
    batches.append_batch(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, batch_id, merge, every)


def held(spark, path):
    return sorted(((r.key, r.n) for r in batches.read_batches(spark, path, SCHEMA).collect()), key=repr)


def folders(path):
    root = Path(path)
    return len(list(root.glob("batch=*"))) + len(list(root.glob("_merged/*")))


def test_rows_stay_and_folders_do_not_grow(spark, folder):
    want, most = [], 0
    for b in range(16):
        rows = [(f"k{b % 7}", b), (None, b)]
        append(spark, folder, b, rows)
        want += rows
        assert held(spark, folder) == sorted(want, key=repr) if b in (0, 2, 3, 15) else True
        most = max(most, folders(folder))
    # two merges of three batches and the one that comes, and a generation or two for each doubling
    assert most <= 7 + 2 * 6
    assert len(list(Path(folder, "_live").glob("[0-9]*"))) <= 2


def test_a_batch_with_its_number(spark, folder):
    for b in range(9):
        append(spark, folder, b, [("a", b)])
    rows = batches.read_batches(spark, folder, SCHEMA).collect()
    assert sorted((r.n, r.batch) for r in rows) == [(b, b) for b in range(9)]


def test_merged_rows_count_for_those_they_hold(spark, folder):
    merge = lambda rows: rows.groupBy("key").agg(F.sum("n").alias("n"), F.max("batch").alias("batch"))
    for b in range(20):
        append(spark, folder, b, [("a", 1), ("b", b)], merge=merge)
    total = batches.read_batches(spark, folder, SCHEMA).groupBy("key").agg(F.sum("n").alias("n"))
    assert {r.key: r.n for r in total.collect()} == {"a": 20, "b": 190}
    assert batches.read_batches(spark, folder, SCHEMA).count() < 20


def test_a_reader_from_before_a_merge(spark, folder):
    for b in range(4):
        append(spark, folder, b, [("a", b)], every=9)
    before = batches.read_batches(spark, folder, SCHEMA)
    assert batches.compact(spark, folder, SCHEMA, lambda rows: rows, 4, 4)
    assert sorted(r.n for r in before.collect()) == [0, 1, 2, 3] == sorted(n for _, n in held(spark, folder))
    assert not batches.compact(spark, folder, SCHEMA, lambda rows: rows, 4, 4)


def test_a_merge_that_fails_changes_nothing(spark, folder, monkeypatch):
    for b in range(4):
        append(spark, folder, b, [("a", b)], every=9)
    broken = lambda rows: rows.withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        batches.compact(spark, folder, SCHEMA, broken, 4, 4)
    assert held(spark, folder) == [("a", b) for b in range(4)]

    def dies(self, name, text):
        raise RuntimeError("died before the list")

    with monkeypatch.context() as patch:
        patch.setattr(batches.Folder, "publish", dies)
        with pytest.raises(RuntimeError, match="died"):
            batches.compact(spark, folder, SCHEMA, lambda rows: rows, 4, 4)
    assert held(spark, folder) == [("a", b) for b in range(4)]
    assert batches.compact(spark, folder, SCHEMA, lambda rows: rows, 4, 4)
    assert held(spark, folder) == [("a", b) for b in range(4)]
    # what the failed merges left behind is gone
    assert len(list(Path(folder, "_merged").glob("*"))) == 1


def test_a_list_is_never_written_twice(spark, folder):
    there = batches.Folder(spark, folder)
    there.publish("_live/0000000001", "{}")
    with pytest.raises(RuntimeError, match="already"):
        there.publish("_live/0000000001", "{}")
    assert there.read("_live/0000000001") == "{}" and there.names("_live") == ["0000000001"]


def test_a_repeated_batch_replaces_the_first_try(spark, folder):
    for b in (0, 1, 1, 2, 3, 3, 4, 4):
        append(spark, folder, b, [("a", b)], every=2)
    assert held(spark, folder) == [("a", b) for b in range(5)]


def test_another_checkpoint_is_refused(spark, folder):
    for b in range(4):
        append(spark, folder, b, [("a", b)], every=2)
    with pytest.raises(ValueError, match="not its checkpoint"):
        append(spark, folder, 0, [("a", 7)], every=2)


def files(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_streams_over_many_batches_and_restarts(spark, folder):
    rnd = random.Random(8)
    schema = "app string, id long, phase string, duration double"
    rows, out = [], {k: f"{folder}/{k}" for k in ("phases", "history", "totals")}
    for round_ in range(3):
        for _ in range(4):
            part = [(rnd.choice(["a", "b", None]), rnd.randrange(1000), rnd.choice(["Running", "Failed", None]), 40.0) for _ in range(8)]
            rows += part
            files(spark, folder + "/in", part, schema)
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
        jobs.stream_phases(stream(), "app", ["id", "phase"], out["phases"], folder + "/c1", every=2).awaitTermination()
        stream_history(stream(), "app", ["id"], out["history"], folder + "/c2", n=3, every=2).awaitTermination()
        words = stream().select(F.coalesce("app", F.lit("-")).alias("value"))
        jobs.stream_word_totals(words, out["totals"], folder + "/c3", every=2).awaitTermination()

        batch = spark.createDataFrame(rows, schema)
        found = jobs.current_phases(spark, out["phases"], "app", ["id", "phase"], "app string, phase string, id long")
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, latest_phase(batch, "app", ["id", "phase"]).collect()), key=repr)
        history = current_history(spark, out["history"], "app", "app string, id long, duration double", ["id"], 3)
        want = {k: sorted((r[1] for r in rows if r[0] == k), reverse=True)[:3] for k in {r[0] for r in rows}}
        got = {}
        for r in history.collect():
            got.setdefault(r.app, []).append(r.id)
        assert {k: sorted(v, reverse=True) for k, v in got.items()} == want
        totals = {r.word: r["count"] for r in jobs.word_totals(spark, out["totals"]).collect()}
        assert totals == {k or "-": sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    assert all(folders(path) <= 12 for path in out.values())


# --- the ledger ---------------------------------------------------------------


def enter(spark, path, batch_id, keys, kind="long", every=2, stream="s"):
    entries = spark.createDataFrame([(k, "Unknown") for k in keys], f"key {kind}, phase string")
    batches.write_batch(entries, f"{path}/stream={stream}", batch_id)
    ledger.compact_ledger(spark, f"{path}/stream={stream}", kind, batch_id, every)


def known(spark, path, keys, kind="long", **others):
    asked = spark.createDataFrame([(k,) for k in keys], f"key {kind}")
    return sorted({r.key for r in ledger.known_keys(spark, path, asked, **others).collect()}, key=repr)


@pytest.mark.parametrize("size", [10, ledger.BUCKET_KEYS])
def test_ledger_knows_what_it_holds(spark, folder, size, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKET_KEYS", size)
    for b in range(7):
        enter(spark, folder, b, [100 * b + i for i in range(30)] + [None] * (b == 2))
    asked = list(range(0, 800, 3)) + [None]
    assert known(spark, folder, asked) == sorted([k for k in asked if k is None or (k < 700 and k % 100 < 30)], key=repr)
    assert ledger.ledger_keys(spark, folder, "long").count() == 211
    assert known(spark, folder, [5, 605], stream="s", before=6) == [5]
    enter(spark, folder, 0, [9000], stream="other")
    assert set(known(spark, folder, [5, 9000, 9001])) == {5, 9000}


def test_keys_of_text(spark, folder):
    for b in range(5):
        enter(spark, folder, b, [f"app-{b}", "", "é"], "string")
    assert known(spark, folder, ["app-3", "é", "", "none"], "string") == ["", "app-3", "é"]


def test_only_touched_buckets_are_read(spark, folder, monkeypatch):
    """What a batch reads follows its keys: all other buckets of an old ledger may be unreadable."""
    monkeypatch.setattr(ledger, "BUCKET_KEYS", 50)
    for b in range(5):
        enter(spark, folder, b, range(1000 * b, 1000 * b + 1000), every=4)
    generation = next(Path(folder, "stream=s", "_merged").glob("*"))
    buckets = list(Path(generation, "keys").glob("bucket=*"))
    assert len(buckets) > 60 and len(list(Path(generation, "filters").glob("bucket=*"))) == len(buckets)
    asked = spark.createDataFrame([(5,), (2_500,), (10**9,)], "key long")
    touched = {r.bucket for r in asked.select(ledger._bucket(128)).collect()}
    for kind in ("keys", "filters"):
        for bucket in Path(generation, kind).glob("bucket=*"):
            if int(bucket.name.split("=")[1]) not in touched:
                for file in bucket.glob("*"):
                    file.write_bytes(b"none of this is read")
    assert set(known(spark, folder, [5, 2_500, 10**9])) == {5, 2_500}


def test_a_filter_keeps_unknown_keys_from_the_buckets(spark, folder, monkeypatch):
    monkeypatch.setattr(ledger, "BUCKET_KEYS", 500)
    for b in range(3):
        enter(spark, folder, b, range(1000 * b, 1000 * b + 1000))
    there = batches.Folder(spark, f"{folder}/stream=s")
    generation = batches.live(there).generations[0]
    read = []
    paths = ledger._paths
    monkeypatch.setattr(ledger, "_paths", lambda f, kind, g, b: read.append((kind, len(b))) or paths(f, kind, g, b))
    asked = spark.createDataFrame([(k,) for k in range(10_000, 10_100)], "key long")
    found = ledger._known_in(spark, there, generation, asked, "long")
    buckets = dict(read)
    assert buckets["filters"] >= 4 and buckets["keys"] <= 2
    assert found is None or found.count() == 0


def test_once_over_merged_ledgers(spark, folder):
    schema = "app string, id long"
    rnd, seen = random.Random(9), {}
    for round_ in range(3):
        for _ in range(3):
            rows = [(rnd.choice(["a", "b", "c", "d", "e", "f", None]), rnd.randrange(10**6)) for _ in range(3)]
            files(spark, folder + "/in", rows, schema)
            for key in {k for k, _ in rows}:
                seen.setdefault(key, min(i for k, i in rows if k == key))
            stream = spark.readStream.schema(schema).parquet(folder + "/in")
            jobs.stream_once(stream, "app", ["id"], folder + "/out", folder + "/c", every=2).awaitTermination()
        found = jobs.processed(spark, folder + "/out", schema).collect()
        assert sorted(((r.app, r.id) for r in found), key=repr) == sorted(seen.items(), key=repr)
    assert list(Path(folder).glob("out/ledger/stream=*/_merged/*")) and list(Path(folder).glob("out/results/stream=*/_merged/*"))
