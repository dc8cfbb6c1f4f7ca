"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import checkpoint


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to its smallest neighbour or itself.

    ``large`` ties those above the node, otherwise those up to the node.
    """
    ends = _both(links)
    side = ends if large else ends.where("b < a")
    least = side.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    tied = side.join(least, "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    own = least.select("a", F.col("m").alias("b"))
    others = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.union(others).where("a != b").distinct()


#: Links that a task contracts by itself.
PART = 500_000


def _contract(batches):
    """Ties all nodes of each component of a part to its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ends = [(x, root(x)) for x in parent]
    ends = [(a, b) for a, b in ends if a != b]
    for first in range(0, len(ends), 10_000):
        a, b = zip(*ends[first : first + 10_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """Written links, as few parts as hold ``PART`` links each, contracted in parts."""
    parts = max(1, -(-links.count() // PART))
    return checkpoint(links.repartition(parts).mapInArrow(_contract, "a long, b long")), parts


def components(links: DataFrame) -> DataFrame:
    """Map every node of ``links (a, b)`` to the smallest node it reaches.

    Each task contracts its part of the links to stars. Where there are several
    parts, large and small stars alternate with that until all links are stars
    around the least node; the number of rounds grows with the logarithm of the
    longest path. ``links`` is read twice and should be a written table; each
    round is written to the shared folder. Nodes are longs; loops, repeated and
    reversed links are allowed, links with a null are not.
    """
    now, parts = _contracted(links.select("a", "b"))
    seen = None
    while parts > 1:
        now, _ = _contracted(checkpoint(_stars(_stars(now, True), False)))
        now = checkpoint(_stars(_stars(now, True), False))
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
