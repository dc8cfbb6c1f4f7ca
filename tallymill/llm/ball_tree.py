"""Exact top-k inner products by branch and bound in ball trees.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id. A
ball tree over a shard gives every node a centre and a radius, and with them an
upper bound of the inner product with any vector inside. Nodes are visited in
the order of their bounds and left out once the bound is below the query's
current k-th score. That score is shared: each query first searches its own
shard, and takes what it finds there to all others. Queries are worked on in
blocks, so a task holds one shard and one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.session import checkpoint

SHARD = 8192
BLOCK = 4096
LEAF = 64
#: Factor of the whole numbers that components are turned into.
SCALE = 1024
#: More than the rounding errors of bounds, less than the step between scores.
SLACK = 1e-3


class BallTree:
    """A balanced tree over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, float, int, int, int]] = []  # centre, radius, left, right, leaf
        if len(vectors):
            self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> int:
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        distance = np.sqrt(((points - centre) ** 2).sum(axis=1))
        node = len(self.nodes)
        self.nodes.append((centre, float(distance.max()), -1, -1, -1))
        if len(rows) <= LEAF:
            self.nodes[node] = (*self.nodes[node][:2], -1, -1, len(self.leaves))
            self.leaves.append(rows)
            return node
        one = points[distance.argmax()]
        other = points[((points - one) ** 2).sum(axis=1).argmax()]
        order = np.argsort(points @ (other - one), kind="stable")
        half = len(rows) // 2
        left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.nodes[node] = (*self.nodes[node][:2], left, right, -1)
        return node

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in each leaf; minus infinity where an inner node rules it out."""
        out = np.full((len(queries), len(self.leaves)), -np.inf)
        norms = np.sqrt((queries**2).sum(axis=1))
        open_nodes = [(0, np.arange(len(queries)))] if self.nodes else []
        while open_nodes:
            node, active = open_nodes.pop()
            centre, radius, left, right, leaf = self.nodes[node]
            bound = queries[active] @ centre + norms[active] * radius + SLACK
            inside = bound >= least[active]
            active, bound = active[inside], bound[inside]
            if leaf >= 0:
                out[active, leaf] = bound
            elif len(active):
                open_nodes += [(left, active), (right, active)]
        return out

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray):
        """Scores and ids of the best ``k`` rows of each query that reach ``least``; ties to smaller ids."""
        n = len(queries)
        scores = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)
        least = least.copy()
        bound = self.bounds(queries, least)

        def visit(leaf: int, active: np.ndarray) -> None:
            rows = self.leaves[leaf]
            new = queries[active] @ self.vectors[rows].T
            new[query_ids[active][:, None] == ids[rows][None, :]] = -np.inf
            better = new.max(axis=1) >= least[active]
            active, new = active[better], new[better]
            if not len(active):
                return
            every = np.concatenate([scores[active], new], axis=1)
            names = np.concatenate([found[active], np.broadcast_to(ids[rows], new.shape)], axis=1)
            order = np.lexsort((names, -every), axis=1)[:, :k]
            scores[active] = np.take_along_axis(every, order, axis=1)
            found[active] = np.take_along_axis(names, order, axis=1)
            least[active] = np.maximum(least[active], scores[active, -1])

        if not self.leaves:
            return scores, found
        # each query's most promising leaf first, then the others by their bounds
        first = bound.argmax(axis=1)
        open_first = bound.max(axis=1) > -np.inf
        for leaf in np.unique(first[open_first]):
            active = np.flatnonzero(open_first & (first == leaf))
            visit(leaf, active)
            bound[active, leaf] = -np.inf
        for leaf in np.argsort(-bound.max(axis=0)):
            active = np.flatnonzero((bound[:, leaf] >= least) & (bound[:, leaf] > -np.inf))
            if len(active):
                visit(leaf, active)
        return scores, found


def _whole_numbers(id_column: str, column: str):
    def turn(batches):
        for batch in batches:
            ids, dims, packed = [], [], []
            for vec_id, v in zip(batch.column(id_column).to_pylist(), batch.column(column)):
                if vec_id is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    packed.append(np.floor(SCALE * x).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "vector"]
            )

    return turn


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["vector"]), np.float64).reshape(len(rows), -1)


def _hits(queries: pd.DataFrame, scores: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    real = scores > -np.inf
    row, _ = np.nonzero(real)
    return pd.DataFrame(
        {"query_id": queries["vec_id"].to_numpy()[row], "q": queries["q"].to_numpy()[row], "vec_id": found[real], "score": scores[real].astype(np.int64)}
    )


_HITS = "query_id long, q long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int, every: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of each query, exactly.

    Queries are the vectors whose id is divisible by ``every``, candidates all
    vectors with another id. Components become floor(1024 * x); scores are exact
    while they stay below 2**53. Returns ``query_id, rank, vec_id, score``, ties
    to smaller ids, fewer rows where there are fewer candidates. Rows without
    id, without components, or with one that is null or not finite take no part.
    Vectors meet vectors of their own length only. Repeated rows are candidates
    each, but one query. An empty table gives no rows.
    """
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector_"))
    kept = checkpoint(kept.mapInArrow(_whole_numbers("vec_id", "vector_"), "vec_id long, dim int, vector binary"))
    counts = kept.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-counts[0] // SHARD)), max(1, -(-counts[1] // BLOCK))
    kept = kept.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    queries = kept.where(F.col("vec_id") % every == 0).withColumn("q", F.xxhash64("vec_id", "vector"))
    queries = queries.dropDuplicates(["vec_id", "q"])

    def at_home(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries, ids = _matrix(right), left["vec_id"].to_numpy(np.int64)
        none = np.full(len(right), -np.inf)
        scores, _ = BallTree(_matrix(left)).search(ids, queries, right["vec_id"].to_numpy(np.int64), k, none)
        # what reaches the k-th score here may still tie with it elsewhere
        return pd.DataFrame({"q": right["q"], "vec_id": right["vec_id"], "least": scores[:, -1]})

    home = checkpoint(queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))))
    home_blocks = kept.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    groups = ["dim", "shard", "block"]
    bounds = home_blocks.groupBy(groups).cogroup(home.groupBy(groups)).applyInPandas(
        lambda left, right: at_home(left, right) if len(left) and len(right) else pd.DataFrame({"q": [], "vec_id": [], "least": []}),
        "q long, vec_id long, least double",
    )
    known = checkpoint(home.join(bounds, ["q", "vec_id"]))
    everywhere = known.drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))

    def abroad(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        scores, found = BallTree(_matrix(left)).search(
            left["vec_id"].to_numpy(np.int64), _matrix(right), right["vec_id"].to_numpy(np.int64), k, right["least"].to_numpy(np.float64)
        )
        return _hits(right, scores, found)

    hits = home_blocks.groupBy(groups).cogroup(everywhere.groupBy(groups)).applyInPandas(abroad, _HITS)
    best = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
