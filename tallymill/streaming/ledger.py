"""A set of keys that grows for years and is asked about the keys of a batch.

Entries come as batches. Merged, they are dealt to buckets of about
``BUCKET_KEYS`` keys, each a folder, and each bucket has a Bloom filter of fixed
size, in a folder too. To find out which keys of a batch are known, only the
filters of their buckets are read, and then the keys of those buckets whose
filter lets one through. A bucket stays as large as it is while their number
grows, so what is read follows the batch and not the age of the ledger; there
are as many generations as the logarithm of the number of merges.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import broadcast_if_small, is_small
from tallymill.streaming.batches import (
    MERGE_EVERY,
    Folder,
    Generation,
    Live,
    due,
    live,
    replace,
    stream_names,
)

#: Keys of a bucket, about, and bits and hashes of its filter for each of them.
BUCKET_KEYS = 1 << 16
KEY_BITS = 16
HASHES = 4

_WORD = 64


def _hash(n: int) -> Column:
    return F.xxhash64(F.lit(n), F.col("key"))


def _bucket(buckets: int) -> Column:
    return F.pmod(_hash(0), F.lit(buckets)).cast("int").alias("bucket")


def _places() -> Column:
    """The bits of a key in the filter of its bucket."""
    bits = F.lit(BUCKET_KEYS * KEY_BITS)
    return F.array_distinct(F.array(*[F.pmod(_hash(n), bits) for n in range(1, HASHES + 1)]))


def _entries(spark: SparkSession, path: str, kind: str, now: Live) -> DataFrame:
    """The keys of the batches that are not merged yet, with the number of the batch."""
    entries = spark.read.schema(f"key {kind}, phase string, batch long").option("basePath", path).parquet(path)
    return entries.where((F.col("batch") > now.upto) & (F.coalesce("phase", F.lit("")) != "")).select("key", "batch")


def _keys_of(spark: SparkSession, path: str, kind: str, generation: Generation) -> DataFrame:
    return spark.read.schema(f"key {kind}").parquet(f"{path}/_merged/{generation.folder}/keys").select("key")


def _paths(folder: Folder, kind: str, generation: Generation, buckets: list[int]) -> list[str]:
    """The folders of some buckets; a bucket without keys has none."""
    base = f"_merged/{generation.folder}/{kind}"
    there = set(folder.names(base))
    return [f"{folder.path}/{base}/bucket={b}" for b in buckets if f"bucket={b}" in there]


def _numbers(df: DataFrame) -> list[int]:
    return [r.bucket for r in df.select("bucket").distinct().collect()]


def _known_in(spark: SparkSession, folder: Folder, generation: Generation, keys: DataFrame, kind: str) -> DataFrame | None:
    """Those of ``keys`` that a generation holds, or none."""
    base = f"{folder.path}/_merged/{generation.folder}"
    asked = keys.select("key", _bucket(generation.facts["buckets"]))
    filters = _paths(folder, "filters", generation, _numbers(asked))
    if not filters:
        return None
    words = spark.read.schema("word long, bits long, bucket int").option("basePath", f"{base}/filters").parquet(*filters)
    places = asked.select("key", "bucket", F.explode(_places()).alias("place"))
    places = places.withColumn("word", F.floor(F.col("place") / _WORD))
    hit = F.getbit("bits", (F.col("place") % _WORD).cast("int")) == 1
    hits = broadcast_if_small(places).join(words, ["bucket", "word"]).where(hit).groupBy("key", "bucket").count()
    maybe = hits.where(F.col("count") == F.size(_places())).select("bucket")
    paths = _paths(folder, "keys", generation, _numbers(maybe))
    if not paths:
        return None
    held = spark.read.schema(f"key {kind}, bucket int").option("basePath", f"{base}/keys").parquet(*paths)
    return _among(held, keys)


def _among(held: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys of ``held`` that are among ``keys``; few keys are sent to them. A null key is a key."""
    wanted = keys.select(F.col("key").alias("wanted"))
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted
    return held.select("key").join(wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi")


def known_keys(spark: SparkSession, path: str, keys: DataFrame, stream: str | None = None, before: int = 0) -> DataFrame:
    """Those of ``keys (key)``, distinct and read several times, that the ledger below ``path`` holds.

    Entries that ``stream`` has written from the batch ``before`` on do not
    count; that batch is being repeated. The result may name a key twice.
    """
    kind = keys.schema["key"].dataType.simpleString()
    found = []
    for name in stream_names(spark, path):
        folder = Folder(spark, f"{path}/stream={name}")
        now = live(folder)
        found += [_known_in(spark, folder, g, keys, kind) for g in now.generations]
        young = _entries(spark, folder.path, kind, now)
        found.append(_among(young.where(F.col("batch") < before) if name == stream else young, keys))
    found = [f for f in found if f is not None]
    return reduce(DataFrame.union, found) if found else keys.limit(0)


def compact_ledger(spark: SparkSession, path: str, kind: str, before: int, every: int = MERGE_EVERY) -> bool:
    """Merge the entries of the batches before ``before`` into buckets once there are ``every`` of them."""
    folder = Folder(spark, path)
    now, ids, taken = due(folder, before, every)
    if not ids:
        return False
    young = _entries(spark, path, kind, now).where(F.col("batch") < before).select("key")
    keys = reduce(DataFrame.union, [young, *[_keys_of(spark, path, kind, g) for g in taken]]).distinct()
    buckets = 1 << (keys.count() // BUCKET_KEYS).bit_length()
    name = f"{ids[0]}-{ids[-1]}-{uuid.uuid4().hex}"
    base = f"{path}/_merged/{name}"
    dealt = keys.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    dealt.write.partitionBy("bucket").parquet(f"{base}/keys")
    places = spark.read.schema(f"key {kind}, bucket int").parquet(f"{base}/keys").select("bucket", F.explode(_places()).alias("place"))
    bit = F.expr(f"shiftleft(1L, cast(place % {_WORD} as int))")
    words = places.groupBy("bucket", F.floor(F.col("place") / _WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    words.repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{base}/filters")
    replace(folder, now, ids, taken, Generation(name, folder.size(f"_merged/{name}"), {"buckets": buckets}))
    return True


def ledger_keys(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All keys of the ledger below ``path``."""
    parts = [spark.createDataFrame([], f"key {kind}")]
    for name in stream_names(spark, path):
        folder = Folder(spark, f"{path}/stream={name}")
        now = live(folder)
        parts.append(_entries(spark, folder.path, kind, now).select("key"))
        parts += [_keys_of(spark, folder.path, kind, g) for g in now.generations]
    return reduce(DataFrame.union, parts).distinct()
