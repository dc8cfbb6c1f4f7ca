"""Manifests that tasks read by themselves."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymill.sources.files import read_manifest
from tallymill.sources.manifests import read_large_manifest

SCHEMA = "id long, at timestamp, price double, name string, day date"


@pytest.fixture
def listed(spark, folder):
    """Folders and single files, and a manifest in two parts that names them."""
    rows = spark.range(300).select(
        "id",
        F.timestamp_seconds(F.col("id") * 100_000 + 0.25).alias("at"),
        (F.col("id") / 7).alias("price"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit('a, "quoted" é\\ '), "id")).alias("name"),
        F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("day"),
    )
    rows.repartition(3).write.option("header", True).csv(f"{folder}/data/a")
    rows.where("id < 50").withColumn("part", F.col("id") % 2).drop("part").repartition(2).write.option("header", True).option("compression", "gzip").csv(f"{folder}/data/b")
    rows.where("id < 0").write.option("header", True).csv(f"{folder}/data/empty")
    one = next(Path(folder, "data", "a").glob("part-*"))
    Path(folder, "list").mkdir()
    Path(folder, "list", "1").write_text(f"{folder}/data/a\n\n   file:{folder}/data/b  \n")
    Path(folder, "list", "2").write_text(f"{folder}/data/empty\r\nfile://{one}")
    Path(folder, "list", "_SUCCESS").write_text("not a path")
    return f"{folder}/list"


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 16])
def test_the_same_rows_for_any_stretch(spark, listed, stretch):
    mine = read_large_manifest(spark, listed, SCHEMA, stretch=stretch)
    assert dict(mine.dtypes) == dict(read_manifest(spark, listed, SCHEMA).dtypes)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(mine) == key(read_manifest(spark, listed, SCHEMA))
    assert mine.count() > 350


def test_many_paths(spark, folder):
    for i in range(600):
        Path(folder, f"{i}.csv").write_text(f"id\n{i}\n{i + 1000}\n")
    Path(folder, "list.txt").write_text("".join(f"{folder}/{i}.csv\n" for i in range(600)))
    found = read_large_manifest(spark, folder + "/list.txt", "id long", stretch=2_000)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(r.id for r in found.collect()) == [*range(600), *range(1000, 1600)]


def test_files_without_header_or_rows(spark, folder):
    with gzip.open(folder + "/a.csv.gz", "wt") as file:
        file.write("1,x\n2,\nno number,y\n")
    Path(folder, "none.csv").write_text("")
    Path(folder, "list").write_text(f"{folder}/a.csv.gz\n{folder}/none.csv\n")
    found = read_large_manifest(spark, folder + "/list", "id long, name string", header=False)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "x"), (2, None), (None, "y")]
    Path(folder, "nothing").write_text("\n \n")
    assert read_large_manifest(spark, folder + "/nothing", "id long").count() == 0


def test_a_path_that_is_not_there(spark, folder):
    Path(folder, "list").write_text(f"{folder}/gone.csv\n")
    with pytest.raises(Exception, match="is not there"):
        read_large_manifest(spark, folder + "/list", "id long").collect()
