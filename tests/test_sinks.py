import subprocess
import sys
from bisect import bisect_right
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallymill.session import broadcast_if_small, checkpoint, checkpoint_dir, scratch_path
from tallymill.session import is_small
from tallymill.sinks.cells import (
    cells,
    read_row,
    read_wide_column,
    sampled_split_keys,
    split_keys,
    write_wide_column,
)
from tallymill.sinks.files import (
    overwrite_versioned,
    read_versioned,
    show,
    write_parquet,
    write_report_csv,
)
from tallymill.sinks.tables import (
    append_table,
    create_empty_table,
    create_or_replace_table,
    ensure_schema,
    restore_table,
)
from tallymill.sources.files import read_csv, read_manifest, read_parquet, read_table
from tallymill.sources.generated import generate_records, typed_literals


def parts(folder):
    return list(Path(folder).glob("part-*"))


def test_report_is_one_sorted_file(spark, folder):
    report = spark.range(0, 500, numPartitions=20).select((-F.col("id")).alias("n"), F.lit("x").alias("t"))
    write_report_csv(report, folder + "/r", ["n"])
    (file,) = parts(folder + "/r")
    lines = file.read_text().splitlines()
    assert lines[0] == "n,t" and [int(x.split(",")[0]) for x in lines[1:]] == list(range(-499, 1))
    write_report_csv(report.limit(1), folder + "/r", ["n"])
    assert read_csv(spark, folder + "/r").count() == 1


def test_a_large_report_is_in_order_over_its_files(spark, folder):
    report = spark.range(0, 20_000, numPartitions=20).select(F.xxhash64("id").alias("n"))
    settings = dict(spark.conf.getAll) if hasattr(spark.conf, "getAll") else None
    write_report_csv(report, folder + "/r", ["n"], file_bytes=20_000)
    assert settings is None or dict(spark.conf.getAll) == settings
    files = sorted(parts(folder + "/r"))
    found = [int(x) for f in files for x in f.read_text().splitlines()[1:]]
    assert len(files) > 1 and len(found) == 20_000 and found == sorted(found)


def test_csv_types_are_inferred_or_given(spark, folder):
    typed_literals(spark).write.option("header", True).csv(folder + "/c")
    inferred = dict(read_csv(spark, folder + "/c").dtypes)
    assert inferred == {"a": "int", "b": "double", "c": "string", "d": "date", "e": "timestamp"}
    given = read_csv(spark, folder + "/c", schema=typed_literals(spark).schema)
    assert sorted(given.collect()) == sorted(typed_literals(spark).collect())
    assert dict(read_csv(spark, folder + "/c", infer=False).dtypes)["a"] == "string"


def test_manifest(spark, folder):
    for n in (1, 2):
        spark.range(n).write.option("header", True).csv(f"{folder}/data{n}")
    Path(folder, "list").write_text(f"{folder}/data1\n\n  {folder}/data2\n")
    assert read_manifest(spark, folder + "/list", "id long").count() == 3


def test_parquet(spark, folder):
    write_parquet(typed_literals(spark), folder + "/p")
    write_parquet(typed_literals(spark), folder + "/p")
    assert sorted(read_parquet(spark, folder + "/p").collect()) == sorted(typed_literals(spark).collect())


def test_versioned_overwrite(spark, folder):
    with pytest.raises(FileNotFoundError):
        read_versioned(spark, folder + "/v")
    overwrite_versioned(spark.range(5), folder + "/v")
    overwrite_versioned(read_versioned(spark, folder + "/v").filter("id > 2"), folder + "/v")
    assert read_versioned(spark, folder + "/v").count() == 2
    # A job that was lost on the way leaves a folder without a marker.
    lost = Path(folder, "v", "version=2")
    lost.mkdir()
    assert read_versioned(spark, folder + "/v").count() == 2
    overwrite_versioned(spark.range(9), folder + "/v")
    assert read_versioned(spark, folder + "/v").count() == 9


def test_old_versions_go_and_no_two_writers_share_one(spark, folder):
    for n in range(5):
        reader = read_versioned(spark, folder + "/v") if n else None
        overwrite_versioned(spark.range(n + 1), folder + "/v")
        assert reader is None or reader.count() == n
    assert [p.name for p in sorted(Path(folder, "v").glob("version=*"))] == ["version=3", "version=4"]
    # another writer is at work on a version; this one takes the next
    Path(folder, "v", "_claims", "0000000005").write_text("")
    overwrite_versioned(spark.range(9), folder + "/v")
    assert Path(folder, "v", "version=6").exists() and not Path(folder, "v", "version=5").exists()
    assert read_versioned(spark, folder + "/v").count() == 9


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    rows = spark.range(50).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.create_map(F.lit("a"), "id").alias("m"))
    assert is_small(rows) and is_small(rows, 50) and not is_small(rows, 49)
    assert not is_small(rows, max_bytes=50_000) and is_small(rows, max_bytes=60_000)
    assert is_small(spark.range(0), 0, 0)


def test_tables(spark, folder):
    ensure_schema(spark, "shop", folder + "/shop")
    ensure_schema(spark, "shop", folder + "/shop")
    create_empty_table(spark, "shop.items", "id long, data string")
    with pytest.raises(AnalysisException):
        create_empty_table(spark, "shop.items", "id long, data string")
    rows = [(1, "one"), (2, "two"), (3, "three"), (4, "four")]
    df = spark.createDataFrame(rows, "id long, data string")
    append_table(df.select("data", "id"), "shop.items")
    assert sorted(map(tuple, read_table(spark, "shop.items").collect())) == rows
    with pytest.raises(ValueError):
        append_table(df.withColumnRenamed("data", "other"), "shop.items")
    create_or_replace_table(spark.range(3), "shop.items")
    assert read_table(spark, "shop.items").columns == ["id"]
    assert len(list(Path(folder, "shop", "items.versions").glob("*"))) == 1
    spark.sql("DROP SCHEMA shop CASCADE")


@pytest.fixture
def shop(spark, folder):
    spark.sql(f"CREATE SCHEMA shop LOCATION '{folder}/shop'")
    yield "shop.items"
    spark.sql("DROP SCHEMA shop CASCADE")


def held(spark, name):
    return sorted(tuple(r) for r in read_table(spark, name).collect())


def lost(df):
    return df.withColumn("id", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))


@pytest.mark.parametrize("managed", [True, False])
def test_a_failed_replacement_leaves_the_old_rows(spark, shop, managed, folder):
    if managed:
        spark.range(4).write.saveAsTable(shop)
    else:
        create_or_replace_table(spark.range(4), shop)
    for broken in (lost(spark.range(9)), lost(spark.range(9)).withColumn("more", F.lit(1))):
        with pytest.raises(Exception, match="lost"):
            create_or_replace_table(broken, shop)
        assert held(spark, shop) == [(0,), (1,), (2,), (3,)]
    assert len(list(Path(folder, "shop", "items.versions").glob("[0-9a-f]*"))) == (0 if managed else 1)


@pytest.mark.parametrize("step", ["ALTER TABLE shop.items SET LOCATION", "createTable"])
def test_a_replacement_that_dies_on_its_last_step(spark, shop, step, monkeypatch):
    create_or_replace_table(spark.range(4), shop)
    rows = spark.range(2) if step.startswith("ALTER") else spark.range(2).withColumn("more", F.lit(1))
    with monkeypatch.context() as patch:
        if step == "createTable":
            patch.setattr(type(spark.catalog), "createTable", lambda *a, **k: 1 / 0)
        else:
            sql = spark.sql
            patch.setattr(type(spark), "sql", lambda self, text, *a, **k: 1 / 0 if text.startswith(step) else sql(text, *a, **k))
        with pytest.raises(ZeroDivisionError):
            create_or_replace_table(rows, shop)
    assert held(spark, shop) == [(0,), (1,), (2,), (3,)]
    create_or_replace_table(rows, shop)
    assert len(held(spark, shop)) == 2


def test_a_table_whose_process_ended_between_two_steps(spark, shop):
    create_or_replace_table(spark.range(4), shop)
    spark.sql(f"ALTER TABLE {shop} RENAME TO shop.items__replaced")
    assert restore_table(spark, shop) and not restore_table(spark, shop)
    assert held(spark, shop) == [(0,), (1,), (2,), (3,)]
    spark.sql(f"ALTER TABLE {shop} RENAME TO shop.items__replaced")
    create_or_replace_table(spark.range(1), shop)
    assert held(spark, shop) == [(0,)] and not spark.catalog.tableExists("shop.items__replaced")


def test_a_table_replaced_from_itself(spark, shop, folder):
    create_or_replace_table(spark.range(4), shop)
    for n in (4, 5, 6):
        reader = read_table(spark, shop)
        create_or_replace_table(read_table(spark, shop).union(spark.range(n, n + 1)), shop)
        # who has begun to read goes on with the rows of then
        assert reader.count() == n and len(held(spark, shop)) == n + 1
    append_table(spark.range(7, 8), shop)
    assert [r[0] for r in held(spark, shop)] == list(range(8))
    assert len(list(Path(folder, "shop", "items.versions").glob("[0-9a-f]*"))) == 2
    create_or_replace_table(read_table(spark, shop).select(F.col("id").alias("n")), shop, "json")
    assert read_table(spark, shop).columns == ["n"] and len(held(spark, shop)) == 8


CATALOG = """{"table": {"namespace": "default", "name": "t"}, "rowkey": "key", "columns": {
  "key": {"cf": "rowkey", "col": "key", "type": "string"},
  "value": {"cf": "cf1", "col": "value", "type": "string"},
  "n": {"cf": "cf2", "col": "count", "type": "int"}}}"""


def test_cells(spark, folder):
    df = spark.createDataFrame([("row1", "Hello", 1), ("zz", None, 2), ("aaaaaaa", "x", None)],
                               "key string, value string, n int")
    assert cells(df, CATALOG).count() == 4
    write_wide_column(df, CATALOG, folder + "/w")
    found = sorted(map(tuple, read_wide_column(spark, folder + "/w").collect()))
    assert found == [
        ("aaaaaaa", "cf1", "value", "x", 0),
        ("row1", "cf1", "value", "Hello", 3),
        ("row1", "cf2", "count", "1", 3),
        ("zz", "cf2", "count", "2", 4),
    ]


KEYED = """{"rowkey": "key", "columns": {"key": {"cf": "rowkey", "col": "key", "type": "string"},
  "value": {"cf": "cf1", "col": "value", "type": "string"}}}"""


@pytest.mark.parametrize("sample", [20_000, 900])
def test_regions_by_the_keys_there_are(spark, folder, sample):
    numbers = spark.range(6_000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    # a key that a third of the rows have is one key
    rows = numbers.union(spark.range(3_000).select(F.lit("17"), F.lit("w")))
    splits = sampled_split_keys(rows.select("key"), 5, sample)
    assert splits == sampled_split_keys(rows.repartition(7).select("key"), 5, sample) == sorted(splits)
    write_wide_column(numbers, KEYED, folder + "/w", splits=splits)
    sizes = {r.region: r["count"] for r in read_wide_column(spark, folder + "/w").groupBy("region").count().collect()}
    assert len(sizes) == 5 and all(600 <= n <= 2400 for n in sizes.values())


def test_reads_of_keys_open_their_regions_only(spark, folder):
    numbers = spark.range(3_000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    splits = sampled_split_keys(numbers.select("key"), 5)
    write_wide_column(numbers, KEYED, folder + "/w", splits=splits)
    for key in ("0", "1234", splits[0], splits[-1], "2999", "999"):
        one = read_row(spark, folder + "/w", key)
        assert [r.rowkey for r in one.collect()] == [key]
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan
    # the files of all regions but one may be gone
    kept = bisect_right(splits, "1234")
    for region in Path(folder, "w").glob("region=*"):
        if region.name != f"region={kept}":
            for file in region.glob("*/*.parquet"):
                file.write_bytes(b"not read")
    assert read_row(spark, folder + "/w", "1234").count() == 1
    low, high = splits[kept - 1], max(f"{n}" for n in range(3_000) if f"{n}" < splits[kept])
    found = sorted(r.rowkey for r in read_wide_column(spark, folder + "/w", low, high).collect())
    assert found == sorted(f"{n}" for n in range(3_000) if low <= f"{n}" <= high)


def test_splits_of_few_or_no_keys(spark, folder):
    none = spark.createDataFrame([], "key string, value string")
    assert sampled_split_keys(none.select("key"), 5) == [] and sampled_split_keys(none.select("key"), 1) == []
    two = spark.createDataFrame([("b", "x"), ("a", None), (None, "y"), ("b", "z")], "key string, value string")
    assert sampled_split_keys(two.select("key"), 5) == ["a", "b"]
    write_wide_column(two, KEYED, folder + "/w", splits=["a", "b"])
    assert [r.value for r in read_row(spark, folder + "/w", "b").orderBy("value").collect()] == ["x", "z"]


def test_split_keys():
    splits = split_keys(5)
    assert len(splits) == 4 and splits == sorted(splits)
    assert "aaaaaaa" < splits[0] and splits[-1] < "zzzzzzz"
    assert split_keys(1) == []


def test_generated_records(spark):
    rows = generate_records(spark, 1000, seed=3).collect()
    assert rows == generate_records(spark, 1000, seed=3).collect()
    assert all(1 <= r.int_field <= 1000 and len(r.text_field) == 10 for r in rows)
    assert all(r.text_field.isalpha() for r in rows)
    assert len({r.text_field for r in rows}) > 900 and len({r.int_field for r in rows}) > 400
    for r in rows:
        assert "2021-01-01" <= r.date_field <= "2021-12-26"
    assert len({r.date_field[:7] for r in rows}) == 12
    assert rows != generate_records(spark, 1000, seed=4).collect()


def test_local_folder(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_folder_of_the_cluster(folder):
    """A session that names a shared folder, with other settings than ours."""
    code = (
        "import sys; sys.path.insert(0, '.')\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', '{folder}/shared/')"
        ".config('spark.sql.session.timeZone', 'America/New_York').getOrCreate())\n"
        "q = e.queries()\n"
        "for n in ('overall_runtime', 'csv_weekday_report', 'log_timestamps', 'table_append'):\n"
        "    print(n, q[n](s, '/root/testdata/sf0.001').count())\n"
        "from tallymill.session import checkpoint\n"
        "print('kept', checkpoint(s.range(4)).count())\n"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
                         cwd=Path(__file__).parents[1])
    assert run.stdout.split() == ["overall_runtime", "1", "csv_weekday_report", "7",
                                  "log_timestamps", "1000", "table_append", "200", "kept", "4"]
    made = {path.name.split("-")[0] for path in Path(folder, "shared").iterdir()}
    assert {"table", "trips"} <= made


def test_broadcast_is_checked(spark):
    def plan(limit):
        side = broadcast_if_small(spark.range(10), limit)
        return spark.range(5).join(side, "id")._jdf.queryExecution().logical().toString()

    assert "broadcast" in plan(10) and "broadcast" not in plan(9)


def test_show(spark, capfd):
    show(spark.range(2))
    assert "id" in capfd.readouterr().out
