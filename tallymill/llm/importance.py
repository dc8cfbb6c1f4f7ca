"""Importance resampling towards a target distribution with a head-tail vocabulary.

Features are runs of words; each falls into a bucket by the CRC-32 of its bytes.
A text's weight is the mean log ratio of its buckets' shares in the target and in
the corpus, and a Gumbel draw without replacement takes the texts with the
highest weight plus noise.

Words that recur are the head. Their exact CRC states, and the buckets of pairs
that recur, are sent to all tasks in tables of bounded size. A word outside the
head takes its CRC from its bytes. A feature outside the head goes on from the
CRC state of its first words over the bytes that follow; as CRC is linear, that
needs the CRC of those bytes and their number alone. So every feature falls into
the bucket its bytes give, whichever way it took, and the totals are exact.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.ordering import running_total
from tallymill.session import checkpoint

BUCKETS = 10_000
#: Draws per hundred eligible texts, and the words that make one eligible.
PER_CENT = 25
LEAST_WORDS = 20
SEED = 7
#: Bytes of text that are worked on at once; only a longer single text exceeds it.
CHUNK = 1 << 20
#: Words and pairs of the head, their longest size in bytes, and how often one
#: has to occur in a chunk to come into question. They decide how a bucket is
#: found, not which.
HEAD_WORDS = 1 << 16
HEAD_PAIRS = 1 << 17
HEAD_BYTES = 64
RECURS = 4
#: Rows of a task that ranks drawn texts.
RANKED = 200_000

# A-Z in lower case, and a blank for every other byte that is in no word.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of ``[0-9a-z]`` and characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TABLE).split(b" ")


def _shift_table(longest: int) -> np.ndarray:
    """What each byte of a CRC state has turned into after so many zero bytes."""
    once = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        once = (once >> np.uint32(1)) ^ np.where(once & 1, np.uint32(0xEDB88320), np.uint32(0))
    table = np.zeros((longest + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32) << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(longest):
        table[n + 1] = (table[n] >> np.uint32(8)) ^ once[table[n] & 255]
    return table


_SHIFTS = _shift_table(HEAD_BYTES + 1)


def crc_after(before: np.ndarray, following: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings put together, from that of each and the length of the second."""
    states, lengths = before, lengths.copy()
    while True:
        steps = np.minimum(lengths, len(_SHIFTS) - 1)
        moved = np.zeros(len(states), np.uint32)
        for place in range(4):
            moved ^= _SHIFTS[steps, place, (states >> np.uint32(8 * place)) & 255]
        lengths -= steps
        states = moved
        if not lengths.any():
            return states ^ following


class Head:
    """Frequent words with their CRC states and sizes, and the buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.numbers = {w: i for i, w in enumerate(words)}
        self.crcs = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        coded = {}
        for pair in pairs:
            a, b = (self.numbers.get(w) for w in pair.split(b" "))
            if a is not None and b is not None:
                coded[a << 32 | b] = zlib.crc32(pair) % buckets
        self.pairs = np.array(sorted(coded), np.int64)
        self.pair_buckets = np.array([coded[p] for p in self.pairs.tolist()], np.int64)


class _Numbers(dict):
    """Numbers of words: those of the head have theirs, a new one gets the next."""

    def __init__(self, head: Head):
        super().__init__()
        self.head, self.tail = head.numbers, []

    def __missing__(self, word: bytes) -> int:
        number = self.head.get(word)
        if number is None:
            number = len(self.head) + len(self.tail)
            self.tail.append(word)
        self[word] = number
        return number


def _chunks(batches) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Identifiers and words of texts, about ``CHUNK`` bytes at a time."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        ids, held, size = [], [], 0
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if held and size + len(text) > CHUNK:
                yield ids, held
                ids, held, size = [], [], 0
            ids.append(doc_id)
            held.append([w for w in words_of(text) if w])
            size += len(text)
        if held:
            yield ids, held


def feature_buckets(texts: list[list[bytes]], head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and pairs of each text, and the number of features before each text."""
    known = _Numbers(head)
    numbers = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]
    counts = np.array([len(n) for n in numbers], np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
    # the tail takes its CRC from its bytes
    crcs = np.concatenate([head.crcs, np.array([zlib.crc32(w) for w in known.tail], np.uint32)])
    sizes = np.concatenate([head.sizes, np.array([len(w) for w in known.tail], np.int64)])
    found = [(crcs % np.uint32(buckets)).astype(np.uint16)[flat]]

    first, second, pair_row = flat[:-1], flat[1:], row[1:]
    inside = row[:-1] == pair_row
    first, second, pair_row = first[inside], second[inside], pair_row[inside]
    bucket = np.zeros(len(first), np.uint16)
    pairs = first << 32 | second
    at = np.minimum(np.searchsorted(head.pairs, pairs), max(len(head.pairs) - 1, 0))
    frequent = head.pairs[at] == pairs if len(head.pairs) else np.zeros(len(pairs), bool)
    bucket[frequent] = head.pair_buckets[at[frequent]]
    # other pairs go on from the state of the first word over a blank and the second
    other = np.flatnonzero(~frequent)
    used = np.unique(second[other])
    following = np.zeros(len(crcs), np.uint32)
    following[used] = crc_after(np.full(len(used), zlib.crc32(b" "), np.uint32), crcs[used], sizes[used])
    tail = crc_after(crcs[first[other]], following[second[other]], sizes[second[other]] + 1)
    bucket[other] = (tail % np.uint32(buckets)).astype(np.uint16)
    found.append(bucket)

    order = np.argsort(np.concatenate([row, pair_row]), kind="stable")
    n_features = counts + np.maximum(counts - 1, 0)
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(n_features)])


def _texts(df: DataFrame, doc_id: str | None) -> DataFrame:
    key = F.col(doc_id).cast("long") if doc_id else F.lit(None).cast("long")
    return df.select(key.alias("id"), F.col("text").cast("string").alias("text"))


def head_of(docs: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS, buckets: int = BUCKETS) -> Head:
    """The words and pairs that recur most often, from counts over all chunks of all texts."""

    def count(batches):
        for _, texts in _chunks(batches):
            for kind in (1, 2):
                counts: Counter[bytes] = Counter()
                for held in texts:
                    counts.update(held if kind == 1 else map(b"%b %b".__mod__, zip(held, held[1:])))
                rows = [(w, n) for w, n in counts.items() if n >= RECURS and len(w) <= HEAD_BYTES]
                for at in range(0, len(rows), 10_000):
                    features, numbers = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(features, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64()), pa.array([kind] * len(features), pa.int32())],
                        names=["feature", "n", "kind"],
                    )

    counts = _texts(docs, None).mapInArrow(count, "feature string, n long, kind int")
    counts = checkpoint(counts.groupBy("kind", "feature").agg(F.sum("n").alias("n")))
    top = [counts.where(F.col("kind") == k).orderBy(F.desc("n"), "feature").limit(m) for k, m in ((1, words), (2, pairs))]
    return Head(*[[r.feature.encode() for r in t.select("feature").collect()] for t in top], buckets)


def bucketed(df: DataFrame, head: Head, doc_id: str | None = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """``id, n_words, n_features, features`` of each text, with the buckets of all features as 16-bit numbers."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    def read(batches):
        for ids, texts in _chunks(batches):
            found, rows = feature_buckets(texts, shared.value, buckets)
            values = found.astype("<u2").tobytes()
            ends = (2 * rows).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(rows).astype(np.int64)),
                    pa.array([values[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
                ],
                names=["id", "n_words", "n_features", "features"],
            )

    return _texts(df, doc_id).mapInArrow(read, "id long, n_words long, n_features long, features binary")


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of ``rows (features)`` fall into each bucket; one number per bucket reaches the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("features"):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    sums = rows.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in sums.collect()}
    return [found.get(b, 0) for b in range(buckets)]


def gains(spark, source: list[int], target: list[int]) -> list[int]:
    """``floor(1000 ln(share in the target / share in the source))`` of each bucket, with one more feature in each."""
    rows = spark.createDataFrame(list(zip(range(len(source)), source, target)), "bucket long, s long, t long")
    many = float(len(source))
    ratio = (F.col("t") + 1.0) * (float(sum(source)) + many) / ((F.col("s") + 1.0) * (float(sum(target)) + many))
    found = rows.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(found)]


def _weigher(gain: np.ndarray):
    def weigh(batches):
        for batch in batches:
            sums = [int(gain[np.frombuffer(v.as_buffer(), "<u2")].sum()) for v in batch.column("features")]
            n = batch.column("n_features").to_pylist()
            weight = pa.array([s // m if m else 0 for s, m in zip(sums, n)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), batch.column("n_features"), weight],
                names=["id", "n_words", "n_features", "weight"],
            )

    return weigh


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, rounded down, that follows from the identifier alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    per_cent: int = PER_CENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    head: Head | None = None,
) -> DataFrame:
    """Draw ``per_cent`` of the eligible texts of ``docs (doc_id, text, ...)`` towards ``target (text, ...)``.

    Returns ``doc_id, n_features, weight, score, rank`` for every row of ``docs``;
    ``rank`` counts the drawn ones from 1 by falling score and rising ``doc_id``
    and is null for others. Texts with fewer than ``least_words`` words are not
    drawn. A null or empty text has no features and weight 0. A null ``doc_id``
    has the noise of an empty one and comes last among ties; equal rows take
    ranks in any order. Other columns are ignored. An empty ``docs`` gives no
    rows; an empty ``target`` counts no features.
    """
    spark = docs.sparkSession
    head = head or head_of(docs)
    rows = checkpoint(bucketed(docs, head))
    gain = np.array(gains(spark, totals(rows), totals(bucketed(target, head, None))), np.int64)
    weighed = rows.mapInArrow(_weigher(gain), "id long, n_words long, n_features long, weight long")
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    ends = -(-n // RANKED) or 1
    # equal rows are told apart by chance, so that no task gets all of them
    ranged = eligible.withColumn("tie", F.rand(1)).repartitionByRange(ends, *order, "tie").drop("tie")
    ranged = checkpoint(ranged.withColumn("part", F.spark_partition_id()))
    ranked = running_total(ranged, [], "part", order, F.lit(1), "before")
    rank = F.when(F.col("before") < n * per_cent // 100, F.col("before") + 1)
    out = ranked.withColumn("rank", rank).unionByName(
        scored.where(F.col("n_words") < least_words), allowMissingColumns=True
    )
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
