"""Best-fit decreasing packing of token sequences of fixed capacity.

Pieces of equal length are interchangeable, so a best-fit decreasing packing is
a function of the number of pieces of each length: at most ``capacity`` numbers
go to the driver, whatever the size of the corpus. There the packing is made run
by run: equal pieces go to equally full sequences, the tightest of which a
segment tree over the remaining capacities finds in logarithmic time. The result
is the packing that placing one piece after the other would give. The tasks then
rank the pieces of each length and look up their places.

The table of runs has at most ``capacity`` new ends a length, not one entry per
document; it is some thousand rows for natural lengths.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.ordering import running_total, salts_for
from tallymill.llm.text_hashes import chunks, give_back
from tallymill.llm.tokens import WordEncoder
from tallymill.session import checkpoint

CAPACITY = 2048
END = b"\0\0\0\0"
#: Bytes of text that are encoded at once; only a longer single text exceeds it.
CHUNK = 1 << 18
#: The column with the number of a written piece.
ROW = "_row"


class Capacities:
    """A segment tree over capacities that finds the least open one at or above a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.open[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, first sequence, offset there, pieces per sequence)``.

    The pieces of a length from that rank on, up to the next run of the length,
    fill sequence after sequence with so many pieces each.
    """
    tree = Capacities(capacity)
    stock: dict[int, list[tuple[int, int]]] = {}
    made, out = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            stock.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                n = -(-(count - rank) // (capacity // length))
                first, made = made, made + n
            else:
                first, n = stock[room].pop()
                tree.add(room, -1)
            each = room // length
            placed = min(count - rank, n * each)
            full, rest = divmod(placed, each)
            out.append((length, rank, first, capacity - room, each))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + (rest > 0), n - full - (rest > 0))
            rank += placed
    return out


def _cutter(path: str, capacity: int, with_ids: bool):
    def cut(batches):
        # there are millions of remembered words and no cycles to collect among them
        gc.disable()
        try:
            yield from cut_all(batches)
        finally:
            gc.enable()
            give_back()

    def cut_all(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            for first, last in chunks(ends, CHUNK):
                texts = [t or "" for t in batch.column("text").slice(first, last - first).to_pylist()]
                doc_ids = batch.column("doc_id").slice(first, last - first).to_pylist()
                rows = []
                for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                    ids += END
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                doc, piece, start, length, crc, part = zip(*rows)
                columns = {
                    "doc_id": pa.array(doc, pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in part], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The ids of every text followed by id 0, cut into pieces of ``capacity`` ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cutter(tokenizer, capacity, with_ids), schema
    )


def _places(spark: SparkSession, table: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The runs of each length as one array; there are at most ``capacity`` rows."""
    by_length: dict[int, list] = {}
    for length, *run in sorted(table):
        by_length.setdefault(length, []).append(tuple(run))
    runs = "array<struct<rank: bigint, first: bigint, offset: bigint, each: bigint>>"
    return spark.createDataFrame(list(by_length.items()), f"length long, runs {runs}")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces (doc_id, piece, length, ids_crc32, ...)``.

    Lengths are 1 to ``capacity``. ``pieces`` is read twice and should be a
    written table. Sequences are numbered from 0 and filled without gaps. The
    result is the same in every run. An empty table gives no rows.

    Pieces with ``ids`` need a number of their own in ``ROW``, which is left out
    of the result: places are found without the ids, which are as large as all
    other columns together, and are moved once to meet them.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = salts_for(sum(counts.values()))
    narrow = [c for c in pieces.columns if c != "ids"]
    salted = pieces.select(*narrow).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = running_total(salted, ["length"], "salt", order, F.lit(1), "rank").select(*narrow, "rank")
    places = F.broadcast(_places(pieces.sparkSession, runs(counts, capacity)))
    ranked = ranked.join(places, "length")
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    ranked = ranked.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.rank"))
    placed = ranked.select(
        *narrow,
        (F.col("run.first") + F.floor(F.col("nth") / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.offset") + F.col("nth") % F.col("run.each") * F.col("length")).alias("offset"),
    )
    if "ids" not in pieces.columns:
        return placed
    return pieces.join(placed.select(ROW, "sequence_id", "offset"), ROW).drop(ROW)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack the texts of ``docs (doc_id, text, ...)`` into as few sequences as best-fit decreasing needs.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, [ids,]
    sequence_id, offset``. A null or empty text is one piece that holds id 0.
    Only texts of more than ``capacity`` ids are cut. Rows with a null or a
    repeated ``doc_id`` are packed like all others; other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity, with_ids)
    if with_ids:
        pieces = pieces.withColumn(ROW, F.monotonically_increasing_id())
    return pack(checkpoint(pieces), capacity)
