"""Tables that a stream writes batch by batch, kept in a bounded number of folders.

Each batch is a folder of its own, ``batch=<id>``, which a repeated batch
replaces. Once enough of them have come, they are merged into a folder of a
generation, together with the younger generations that are not much larger. So a
row is merged again only a logarithmic number of times, and there are as few
folders.

The folders that count are named by a list, a small file that is written aside
and renamed. The rename is the only step that readers can see: before it the
batches count, after it the generation that holds them. Folders that the list
before the last one needed are removed, so a reader may finish what it planned
before a merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill.folders import Folder

#: Batches that are merged together.
MERGE_EVERY = 32
#: A generation joins a merge unless it is so many times as large as what is merged.
GROWTH = 2

Merge = Callable[[DataFrame], DataFrame]


@dataclass
class Generation:
    """A folder of merged batches."""

    folder: str
    size: int
    #: What its writer has to know to read it again.
    facts: dict = field(default_factory=dict)


@dataclass
class Live:
    """The folders that count: generations, oldest first, and all batches after ``upto``."""

    version: int = 0
    upto: int = -1
    generations: list[Generation] = field(default_factory=list)


def live(folder: Folder) -> Live:
    """The newest list of a table."""
    versions = [int(n) for n in folder.names("_live") if n.isdigit()]
    if not versions:
        return Live()
    found = json.loads(folder.read(f"_live/{max(versions):010d}"))
    found["generations"] = [Generation(**g) for g in found["generations"]]
    return Live(**found)


def batch_ids(folder: Folder) -> list[int]:
    return sorted(int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch="))


def _ddl(schema: StructType | str) -> str:
    if isinstance(schema, str):
        return schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _read(spark: SparkSession, path: str, schema: str, now: Live) -> DataFrame:
    columns = f"{schema}, batch long"
    young = spark.read.schema(columns).option("basePath", path).parquet(path).where(F.col("batch") > now.upto)
    if not now.generations:
        return young
    old = spark.read.schema(columns).parquet(*[f"{path}/_merged/{g.folder}" for g in now.generations])
    return old.select(*young.columns).union(young)


def stream_names(spark: SparkSession, path: str) -> list[str]:
    """The streams that share a folder, one below the other."""
    return [n.removeprefix("stream=") for n in Folder(spark, path).names() if n.startswith("stream=")]


def read_batches(spark: SparkSession, path: str, schema: StructType | str, streams: bool = False) -> DataFrame:
    """The rows of all batches so far, with the number of a batch.

    A merged row has the number of the last batch that went into it. ``streams``
    is for folders that several streams share, one below the other.
    """
    schema = _ddl(schema)
    if streams:
        parts = [
            read_batches(spark, f"{path}/stream={name}", schema).withColumn("stream", F.lit(name))
            for name in stream_names(spark, path)
        ]
        if parts:
            return reduce(DataFrame.unionByName, parts)
        return spark.createDataFrame([], f"{schema}, batch long, stream string")
    folder = Folder(spark, path)
    if not folder.exists():
        return spark.createDataFrame([], f"{schema}, batch long")
    return _read(spark, path, schema, live(folder))


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write the rows of a batch; running it again replaces them."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}")


def due(folder: Folder, before: int, every: int) -> tuple[Live, list[int], list[Generation]]:
    """The newest list, and the batches and generations that a merge should take.

    There are none until ``every`` batches before ``before`` have come.
    """
    now = live(folder)
    ids = [i for i in batch_ids(folder) if now.upto < i < before]
    if len(ids) < every:
        return now, [], []
    size, taken = sum(folder.size(f"batch={i}") for i in ids), []
    for generation in reversed(now.generations):
        if generation.size > GROWTH * size:
            break
        taken.append(generation)
        size += generation.size
    return now, ids, taken


def replace(folder: Folder, now: Live, ids: list[int], taken: list[Generation], new: Generation) -> None:
    """Let a generation count for the batches and generations it holds, and remove what no list needs.

    What the list ``now`` needs stays for those who read by it.
    """
    kept = [g for g in now.generations if g not in taken]
    following = Live(now.version + 1, ids[-1], [*kept, new])
    folder.publish(f"_live/{following.version:010d}", json.dumps(asdict(following)))
    for i in batch_ids(folder):
        if i <= now.upto:
            folder.remove(f"batch={i}")
    needed = {g.folder for g in [*now.generations, *following.generations]}
    for name in folder.names("_merged"):
        if name not in needed:
            folder.remove(f"_merged/{name}")
    for name in folder.names("_live"):
        if not name.isdigit() or int(name) < now.version:
            folder.remove(f"_live/{name}")


def compact(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    merge: Merge,
    before: int,
    every: int = MERGE_EVERY,
    partition_by: tuple[str, ...] = (),
) -> bool:
    """Merge the batches before ``before`` once there are ``every`` of them, and say whether that was so.

    ``merge`` turns the rows of some batches, with their numbers in ``batch``,
    into fewer rows of the same columns that count for them. It must not matter
    which rows it has seen together before. Only one stream may write below
    ``path``, and batches before ``before`` must be finished.
    """
    folder = Folder(spark, path)
    now, ids, taken = due(folder, before, every)
    if not ids:
        return False
    rows = _read(spark, path, _ddl(schema), Live(now.version, now.upto, taken)).where(F.col("batch") < before)
    name = f"{ids[0]}-{ids[-1]}-{uuid.uuid4().hex}"
    merge(rows).hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(f"{path}/_merged/{name}")
    replace(folder, now, ids, taken, Generation(name, folder.size(f"_merged/{name}")))
    return True


def append_batch(
    df: DataFrame,
    path: str,
    batch_id: int,
    merge: Merge = lambda rows: rows,
    every: int = MERGE_EVERY,
    partition_by: tuple[str, ...] = (),
) -> None:
    """Write a batch and merge earlier ones when it is time.

    A batch that has been merged cannot be written again: its number comes from
    a checkpoint that is not the one of this folder, which ends the job.
    """
    spark = df.sparkSession
    check_number(Folder(spark, path), batch_id)
    write_batch(df, path, batch_id, partition_by)
    compact(spark, path, df.schema, merge, batch_id, every, partition_by)


def check_number(folder: Folder, batch_id: int) -> None:
    if batch_id <= live(folder).upto:
        raise ValueError(f"batch {batch_id} of {folder.path} was merged before; this is not its checkpoint")
