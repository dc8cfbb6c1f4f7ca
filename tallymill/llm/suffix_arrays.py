"""Repeated passages by sparse suffix arrays.

Texts are sequences of words without regard to the case of A-Z. Of all suffixes
those are retained that begin at a minimiser: in every run of ``WINDOW`` runs of
``K`` words the one with the smallest hash. Two passages of ``LEAST`` equal
words hold ``WINDOW`` equal runs of ``K`` words side by side, so they retain
a suffix at the same place. Retained suffixes whose first ``K`` words recur are
sorted by what follows, neighbours are compared, and each match is extended to
the left and to the right. Context of ``WINDOW`` words to each side is enough:
where a match goes on, the next retained suffix takes over. Where more than two
suffixes begin alike, neighbours may agree less on the left than others do, so
there every passage of ``LEAST`` words that holds the beginning is counted too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymill.llm.key_filter import KeyFilter
from tallymill.llm.text_hashes import binaries, chunks, utf8, windows, word_hashes
from tallymill.session import checkpoint

#: Least words of a repeated passage.
LEAST = 50
K = 16
WINDOW = LEAST - K + 1
FILTER_BITS = 1 << 24
#: Suffixes in a part of a sorted order.
PART = 40_000


def minimisers(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``K`` words that are least in some window of ``WINDOW``."""
    runs, at, before = windows(hashes, rows, K, 31)
    if not len(runs):
        return runs, at
    low, _, lows = windows_least(runs, before)
    # the leftmost least run of each window
    chosen = np.unique(low)
    # rows with fewer runs than a window have one window, of all their runs
    short = np.flatnonzero((np.diff(before) > 0) & (np.diff(before) < WINDOW))
    if len(short):
        least = np.minimum.reduceat(runs, before[short])
        ends = before[short + 1]
        extra = [b + int(np.argmax(runs[b:e] == m)) for b, e, m in zip(before[short], ends, least)]
        chosen = np.unique(np.concatenate([chosen, np.array(extra, np.int64)]))
    return runs[chosen], at[chosen]


def windows_least(runs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``WINDOW`` neighbours in a row, the place of its leftmost least run."""
    n = len(runs)
    place = np.arange(n)
    least, width = runs.copy(), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        other = least[step:]
        take = other < least[: n - step]
        least[: n - step] = np.where(take, other, least[: n - step])
        place[: n - step] = np.where(take, place[step:], place[: n - step])
        width += step
    counts = np.maximum(np.diff(before) - WINDOW + 1, 0)
    starts = np.zeros(len(before), np.int64)
    np.cumsum(counts, out=starts[1:])
    at = np.arange(starts[-1]) + np.repeat(before[:-1] - starts[:-1], counts)
    return place[at], at, starts


def _per_chunk(work):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in chunks(offsets):
                part = offsets[first : last + 1] - offsets[first]
                hashes, rows = word_hashes(data[offsets[first] : offsets[last]], part)
                yield work(ids[first:last], hashes, rows)

    return run


def _keys(ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    key, _ = minimisers(hashes, rows)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])


def _suffixes(recurring: KeyFilter):
    def work(ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        key, at = minimisers(hashes, rows)
        hit = recurring.may_hold(key.view(np.int64))
        key, at = key[hit], at[hit]
        row = np.searchsorted(rows, at, "right") - 1
        # 0 stands for what is beyond the text and equals nothing
        words = np.concatenate([(hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1), [np.uint32(0)]])
        step = np.arange(WINDOW)
        left, right = at[:, None] - 1 - step, at[:, None] + K + step
        left = words[np.where(left >= rows[row][:, None], left, len(hashes))]
        right = words[np.where(right < rows[row + 1][:, None], right, len(hashes))]
        places = np.arange(len(at) + 1) * WINDOW
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key.view(np.int64)),
                pa.array(ids[row]),
                pa.array((at - rows[row]).astype(np.int32)),
                binaries(left.reshape(-1), places),
                binaries(right.reshape(-1), places),
            ],
            names=["key", "doc_id", "at", "left", "right"],
        )

    return work


def _passages(crowded: KeyFilter):
    """Hash and place of every run of ``LEAST`` words that holds a crowded minimiser."""

    def work(ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        key, at = minimisers(hashes, rows)
        at = at[crowded.may_hold(key.view(np.int64))]
        edges = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edges, np.maximum(at - WINDOW + 1, 0), 1)
        np.add.at(edges, at + 1, -1)
        whole, begin, _ = windows(hashes, rows, LEAST, 37)
        hit = np.cumsum(edges)[begin] > 0
        whole, begin = whole[hit], begin[hit]
        row = np.searchsorted(rows, begin, "right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(whole.view(np.int64)), pa.array(ids[row]), pa.array((begin - rows[row]).astype(np.int32))],
            names=["passage", "doc_id", "start"],
        )

    return work


def _context(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, WINDOW)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))


_MATCHES = "doc_id long, start long, stop long, other long"
_EDGES = f"{_MATCHES}, part int, key long, at int, left binary, right binary"


def _matches(doc, at, other, l, r) -> list[np.ndarray]:
    return [doc, at - l, at + K + r, other]


def _compare(batches):
    """Matches of each suffix with its neighbours from other texts in a sorted part.

    The first and last suffix come as edges, to be compared with those of the
    neighbouring parts.
    """
    table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    key, doc = table["key"].to_numpy(), table["doc_id"].to_numpy()
    at = table["at"].to_numpy().astype(np.int64)
    left, right = _context(table["left"]), _context(table["right"])
    n = len(key)
    new_run = np.ones(n, bool)
    new_run[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new_run) - 1
    begins = np.append(np.flatnonzero(new_run), n)
    found = [[], [], [], []]
    for partner in (begins[run] - 1, begins[run + 1]):
        i = np.flatnonzero((partner >= 0) & (partner < n))
        j = partner[i]
        together = key[i] == key[j]
        i, j = i[together], j[together]
        l, r = _agree(left[i], left[j]), _agree(right[i], right[j])
        long = l + K + r >= LEAST
        i, j, l, r = i[long], j[long], l[long], r[long]
        # a match tells of both, as the partner's own neighbours may agree less
        for a, b in ((i, j), (j, i)):
            for out, values in zip(found, _matches(doc[a], at[a], doc[b], l, r)):
                out.append(values)
    columns = [np.concatenate(c) for c in found]
    m = len(columns[0])
    none = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())]
    names = ["doc_id", "start", "stop", "other", "part", "key", "at", "left", "right"]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + none, names=names)
    edge = table.take(pa.array([0, n - 1]))
    part = pa.array([TaskContext.get().partitionId()] * 2, pa.int32())
    yield pa.RecordBatch.from_arrays(
        [edge["doc_id"].combine_chunks(), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), part]
        + [edge[c].combine_chunks() for c in ("key", "at", "left", "right")],
        names=names,
    )


def _across(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        pick = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "at", "doc_id_2", "at_2")}
        l = _agree(_context(batch.column("left")), _context(batch.column("left_2")))
        r = _agree(_context(batch.column("right")), _context(batch.column("right_2")))
        long = l + K + r >= LEAST
        out = []
        for a, b in (("", "_2"), ("_2", "")):
            out.append(_matches(pick[f"doc_id{a}"][long], pick[f"at{a}"].astype(np.int64)[long], pick[f"doc_id{b}"][long], l[long], r[long]))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "start", "stop", "other"])


def _neighbour_matches(suffixes: DataFrame, parts: int) -> DataFrame:
    order = ["key", "right", "doc_id", "at"]
    dealt = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = checkpoint(dealt.mapInArrow(_compare, _EDGES))
    edges = rows.where("part is not null").select("part", "key", "doc_id", "at", "left", "right")
    # two rows of each part, in the order of the parts; the table has no others
    along = Window.orderBy("part", *order)
    pairs = edges.select(
        "*", *[F.lead(c).over(along).alias(f"{c}_2") for c in ("part", "key", "doc_id", "at", "left", "right")]
    ).where("key = key_2 and doc_id != doc_id_2 and part != part_2")
    return rows.where("part is null").select("doc_id", "start", "stop", "other").union(pairs.mapInArrow(_across, _MATCHES))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Passages of at least ``LEAST`` words that occur in another text too.

    Returns ``doc_id, start, stop, n_words, others``: words ``start`` up to
    ``stop``, counted from 0, and the sorted ids of some documents that hold
    parts of it. Copies of a text are reported whole; what they share with
    different texts is reported for the first and the last of them. Null and
    empty texts and rows without ``doc_id`` share nothing. Repeated rows of one
    ``doc_id`` are one document. An empty table gives no rows.
    """
    docs = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    keys = docs.mapInArrow(_per_chunk(_keys), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = checkpoint(keys)
    suffixes = docs.mapInArrow(
        _per_chunk(_suffixes(KeyFilter(keys, FILTER_BITS))), "key long, doc_id long, at int, left binary, right binary"
    )
    suffixes = checkpoint(suffixes.join(keys, "key"))
    count = suffixes.count()
    found = _neighbour_matches(suffixes.drop("n"), max(1, -(-count // PART)))
    crowded = KeyFilter(keys.where("n > 2"), FILTER_BITS)
    return _merged(found.union(_passage_matches(docs, crowded)))


def _passage_matches(docs: DataFrame, crowded: KeyFilter) -> DataFrame:
    """Passages that hold a crowded minimiser and occur in another text, with the first or last such text."""
    held = checkpoint(docs.mapInArrow(_per_chunk(_passages(crowded)), "passage long, doc_id long, start int"))
    shared = held.groupBy("passage").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    other = F.when(F.col("doc_id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    start = F.col("start").cast("long")
    return held.join(shared, "passage").select("doc_id", start.alias("start"), (start + LEAST).alias("stop"), other.alias("other"))


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping matches of a text as one span."""
    found = found.groupBy("doc_id", "start", "stop").agg(F.min("other").alias("other"))
    along = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.withColumn("fresh", F.when(F.col("start") < reach, 0).otherwise(1))
    spans = spans.withColumn("span", F.sum("fresh").over(along))
    spans = spans.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_set("other")).alias("others")
    )
    return spans.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "others")
