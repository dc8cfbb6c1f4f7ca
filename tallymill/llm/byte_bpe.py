"""Byte-level BPE of whole texts by a global shuffle of distinct words.

A text is split into pre-tokens, each with its position. Words that recur are
the head: a bounded table of them is encoded once and sent to every task. All
others go, once for each chunk of texts that holds them, to the task of the
word; it encodes each distinct word once, and its ids go back to the chunk. There
the ids take the positions of their words. Decoding looks every id up in the
table of token bytes, which is as large as the vocabulary.

Texts never move: a chunk is sent as the numbers of its words. A word that is
not in the head reaches its task once for a chunk of ``CHUNK`` bytes, however
often it occurs there.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Characters of text whose words share one numbering; only a longer single text exceeds it.
CHUNK = 1 << 24
#: Words of the head, their longest size in bytes, and how often a word has to
#: occur in one chunk to come into question. They decide what is shuffled, not
#: what comes out.
HEAD = 1 << 18
HEAD_BYTES = 64
RECURS = 2
#: Ids that leave a task at once; only a longer single text exceeds it.
OUT = 1 << 18

CHANGED = "the texts were not the same when they were read again"

#: Characters below this one are split by the standard library, which is faster.
_PLAIN_END = 0x250
#: The planes that hold characters; the others are unassigned or private.
_ASSIGNABLE = [*range(0x80, 0x40000), *range(0xE0000, 0xF0000)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def whole_word_encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """Merges that take any text for a single pre-token."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def _ranges(points: list[int]) -> str:
    """A character class body for sorted code points."""
    out, first = [], None
    for point, following in zip(points, [*points[1:], -1]):
        first = point if first is None else first
        if following != point + 1:
            out.append(f"\\U{first:08x}-\\U{point:08x}")
            first = None
    return "".join(out)


class Splitter:
    """Splits texts into pre-tokens where the tokenizer library does.

    The library and ``regex`` follow different versions of Unicode. Which of its
    classes a character has in the library is seen from whether it merges with
    a letter, a digit or a sign before it; where the two differ, texts with such
    characters are split by classes that leave them out or take them in.
    """

    def __init__(self, pattern: str):
        probes = {"L": "a", "N": "1", "O": "!"}
        ranks = {bytes([i]): i for i in range(256)}
        ranks |= {probe.encode() + bytes([i]): 256 * (n + 1) + i for n, probe in enumerate(probes.values()) for i in range(256)}
        library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "O": regex.compile(r"[^\s\p{L}\p{N}]")}
        points = [i for i in _ASSIGNABLE if not 0xD800 <= i < 0xE000]
        parts = [points[i : i + 10_000] for i in range(0, len(points), 10_000)]
        wrong = {}
        for n, (name, probe) in enumerate(probes.items()):
            found = library.encode_ordinary_batch(["".join(f"{probe}{chr(i)}\n" for i in part) for part in parts], num_threads=8)
            ids = np.array([i for ids in found for i in ids])
            # one line feed ends each probe, and no character has its byte inside
            line = np.cumsum(ids == 0x0A) - (ids == 0x0A)
            merged = np.zeros(len(points), bool)
            merged[line[(ids >= 256 * (n + 1)) & (ids < 256 * (n + 2))]] = True
            mine = np.array([own[name].match(chr(i)) is not None for i in points])
            for sign, which in (("-", mine & ~merged), ("+", merged & ~mine)):
                wrong[name + sign] = [points[i] for i in np.flatnonzero(which)]
        self.pattern = pattern
        self.differing = _ranges(sorted(set().union(*(wrong[n] for n in wrong))))
        self.corrected = self._corrected(pattern, wrong)
        self._compile()

    @staticmethod
    def _corrected(pattern: str, wrong: dict[str, list[int]]) -> str:
        for name in ("L", "N"):
            kind = rf"\p{{{name}}}"
            if wrong[f"{name}-"]:
                kind = f"[{kind}--[{_ranges(wrong[f'{name}-'])}]]"
            if wrong[f"{name}+"]:
                kind = f"[{kind}||[{_ranges(wrong[f'{name}+'])}]]"
            pattern = pattern.replace(rf"\p{{{name}}}", kind)
        return pattern

    def _compile(self) -> None:
        kinds = {}
        for name in ("L", "N"):
            known = regex.compile(rf"\p{{{name}}}")
            kinds[name] = _ranges([i for i in range(_PLAIN_END) if known.match(chr(i))])
        spaces = _ranges([i for i in range(_PLAIN_END) if regex.match(r"\s", chr(i))])
        plain = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{kinds['L']}{kinds['N']}]")
        for name, body in kinds.items():
            plain = plain.replace(rf"\p{{{name}}}", f"[{body}]")
        plain = plain.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
        self._plain = re.compile(plain).findall
        self._is_plain = re.compile(f"[\\0-{chr(_PLAIN_END - 1)}]*").fullmatch
        self._usual = regex.compile(self.pattern).findall
        self._has_differing = re.compile(f"[{self.differing}]").search if self.differing else lambda text: None
        self._unusual = regex.compile(self.corrected, flags=regex.V1).findall

    def __getstate__(self):
        return {"pattern": self.pattern, "differing": self.differing, "corrected": self.corrected}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self._is_plain(text):
            return self._plain(text)
        return self._unusual(text) if self._has_differing(text) else self._usual(text)


class _Numbers(dict):
    """Numbers of words: a copy of those of the head, to which a new word adds the next."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _texts(batches) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        pa.default_memory_pool().release_unused()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for doc_id, text in zip(ids, texts):
            yield doc_id, text.as_py() or ""


def _chunks(batches) -> Iterator[Iterator[tuple[int | None, str]]]:
    """The rows of a task in chunks that do not depend on its batches; each is read to its end."""
    rows = _texts(batches)
    row = next(rows, None)

    def chunk():
        nonlocal row
        size = 0
        while row is not None and (size == 0 or size + len(row[1]) <= CHUNK):
            size += max(len(row[1]), 1)
            yield row
            row = next(rows, None)

    while row is not None:
        yield chunk()


def _numbered(batches, split: Splitter, head: dict[str, int]):
    """Chunks as their number, ``(doc_id, numbers of the words)`` and the words outside the head.

    A chunk's number holds its place among all tasks and 24 bits that follow from
    its words, so that two readings of different rows are never taken for one.
    """
    part = TaskContext.get().partitionId()
    for nth, chunk in enumerate(_chunks(batches)):
        # the copy is made at once, where a look into the head for each new word is not
        known, check, rows = _Numbers(head), 0, []
        for doc_id, text in chunk:
            words = split(text)
            numbers = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
            check = zlib.crc32(numbers, check)
            rows.append((doc_id, numbers))
        rare = list(islice(known, len(head), None))
        check = zlib.crc32("\0".join(rare).encode(), check)
        yield (part << 44) + (nth << 24) + (check & 0xFFFFFF), rows, rare


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed numbers, byte by byte of their four."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T), "zstd", asbytes=True)


def _unpacked(value: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(value, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, cut by the sum of ``size`` over their rows."""
    held, total = [], 0
    for row in rows:
        if held and total + size(row) > OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, total = [], 0
        held.append(row)
        total += size(row)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _encode_words(words: pa.Array, encoding: tiktoken.Encoding, kind: str) -> pa.Array:
    """The ids of each word as numbers of ``kind``; each distinct word is encoded once."""
    coded = words.dictionary_encode()
    ids = list(map(encoding.encode_ordinary, coded.dictionary.to_pylist()))
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(chain.from_iterable(ids), kind, ends[-1])
    places = pa.array(ends * flat.itemsize, pa.int32()).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, places, pa.py_buffer(flat)]).take(coded.indices)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_words(docs: DataFrame, split: Splitter, limit: int = HEAD) -> list[str]:
    """The up to ``limit`` words that recur most often, from counts over all chunks."""

    def count(batches):
        for chunk in _chunks(batches):
            counts: Counter[str] = Counter()
            for _, text in chunk:
                counts.update(split(text))
            rows = [(w, n) for w, n in counts.items() if n >= RECURS and len(w) <= HEAD_BYTES and len(w.encode()) <= HEAD_BYTES]
            for at in range(0, len(rows), 10_000):
                words, numbers = zip(*rows[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])

    counts = _named(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(limit)
    return [r.word for r in top.select("word").collect()]


def _encoded(docs: DataFrame, ranks: str, pattern: str, head: int, tables: dict[str, list[bytes]] | None) -> DataFrame:
    """The ids of every text, or what each of ``tables`` holds for them, put together."""
    docs = _named(docs)
    send = docs.sparkSession.sparkContext.broadcast
    by_token, split = read_ranks(ranks), Splitter(pattern)
    kind = "<u2" if max(by_token.values()) < 1 << 16 else "<u4"
    words = frequent_words(docs, split, head)
    head_ids = [np.array(i, kind) for i in map(whole_word_encoding(by_token).encode_ordinary, words)]
    # a task gets the words or their ids, whichever it works with
    numbering = send((split, {w: i for i, w in enumerate(words)}))
    known_ids = send((np.concatenate([*head_ids, np.zeros(0, kind)]), np.cumsum([0, *map(len, head_ids)])))
    tokens = send(by_token)
    joined = None if tables is None else send(tables)
    n_head = len(words)
    del words, head_ids

    def rare(batches):
        for chunk, _, words in _numbered(batches, *numbering.value):
            for at in range(0, len(words), 10_000):
                part = words[at : at + 10_000]
                numbers = np.arange(at, at + len(part), dtype=np.int32) + n_head
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array(np.full(len(part), chunk)), pa.array(numbers)], names=["word", "chunk", "number"]
                )

    def texts(batches):
        def rows():
            for chunk, held, _ in _numbered(batches, *numbering.value):
                for doc_id, numbers in held:
                    yield chunk, None, doc_id, len(numbers), _packed(numbers)

        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield from _batched(rows(), ["chunk", "number", "doc_id", "n_words", "value"], types, lambda row: 64 + len(row[4]))

    def encode_rare(batches):
        encoding = whole_word_encoding(tokens.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("number"), _encode_words(batch.column("word"), encoding, kind)],
                names=["chunk", "number", "value"],
            )

    def place(batches):
        first, ends = known_ids.value
        spelled = None if joined is None else _flat(joined.value)
        for doc_ids, ids in _held(_placed(batches, first, ends)):
            places = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            if spelled is None:
                made = [pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(ids).astype(np.int32)))]
            else:
                made = [pa.array(np.diff(places).astype(np.int64)), *_spelled(spelled, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *made], names=names)

    names = ["doc_id", "ids"] if tables is None else ["doc_id", "n_tokens", *tables]
    schema = "doc_id long, ids array<int>" if tables is None else ", ".join(["doc_id long, n_tokens long", *[f"{n} binary" for n in tables]])
    found = docs.mapInArrow(rare, "word string, chunk long, number int").repartition("word").sortWithinPartitions("word")
    found = found.mapInArrow(encode_rare, "chunk long, number int, value binary")
    held = docs.mapInArrow(texts, "chunk long, number int, doc_id long, n_words long, value binary")
    together = held.unionByName(found, allowMissingColumns=True).repartition("chunk")
    return together.sortWithinPartitions("chunk", F.col("number").asc_nulls_last()).mapInArrow(place, schema)


def _placed(batches, first: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of the texts of a task; the ids of a chunk's rare words come before its texts."""
    n_head = len(ends) - 1
    here, flat, starts, rare_ids = None, None, None, []
    for batch in batches:
        pa.default_memory_pool().release_unused()
        columns = [batch.column(c) for c in ("chunk", "number", "doc_id", "n_words", "value")]
        for chunk, number, doc_id, n_words, value in zip(*(c.to_pylist() for c in columns)):
            if chunk != here:
                here, flat, rare_ids = chunk, None, []
            if number is not None:
                if number != n_head + len(rare_ids):
                    raise RuntimeError(CHANGED)
                rare_ids.append(value)
                continue
            if flat is None:
                flat = np.concatenate([first, np.frombuffer(b"".join(rare_ids), first.dtype)])
                starts = np.concatenate([ends, ends[-1] + np.cumsum(list(map(len, rare_ids)), dtype=np.int64) // first.itemsize])
            numbers = _unpacked(value, n_words)
            if n_words and int(numbers.max()) >= len(starts) - 1:
                raise RuntimeError(CHANGED)
            yield doc_id, _gather(flat, starts, numbers)


def encode(docs: DataFrame, ranks: str, pattern: str, head: int = HEAD) -> DataFrame:
    """The ids of every text of ``docs (doc_id, text, ...)`` as the tokenizer library gives them.

    ``ranks`` is a file of token ranks, ``pattern`` splits texts into words.
    Returns a row ``doc_id, ids`` per row of ``docs``; a null or empty text has
    no ids, a null or repeated ``doc_id`` stays as it is, other columns are
    ignored and an empty table gives no rows. Special tokens are ordinary text.

    ``docs`` is read three times and must give the same rows in the same tasks
    each time, as a table in files does; otherwise the job ends with an error.
    """
    return _encoded(docs, ranks, pattern, head, None)


def _gather(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``numbers`` name, behind one another."""
    begins = starts[numbers]
    lengths = starts[numbers + 1] - begins
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])]


def _held(rows) -> Iterator[tuple[list, list]]:
    """Keys and arrays in groups of about ``OUT`` elements."""
    keys, values, total = [], [], 0
    for key, value in rows:
        if keys and total + len(value) > OUT:
            yield keys, values
            keys, values, total = [], [], 0
        keys.append(key)
        values.append(value)
        total += len(value)
    if keys:
        yield keys, values


def _flat(tables: dict[str, list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])) for t in tables.values()]


def _spelled(flat: list[tuple[np.ndarray, np.ndarray]], ids: list[np.ndarray]) -> list[pa.Array]:
    """For each table, what it holds for the ids of every text, put together."""
    return [pa.array([_gather(*table, i).tobytes() for i in ids], pa.binary()) for table in flat]


def _token_bytes(ranks: str) -> list[bytes]:
    by_id = {rank: token for token, rank in read_ranks(ranks).items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add ``decoded``, the bytes that the ids of ``encoded (ids, ...)`` stand for.

    Every id takes its bytes from the table of tokens, which each task holds; a
    null list has none. An id outside the vocabulary ends the job.
    """
    shared = encoded.sparkSession.sparkContext.broadcast({"decoded": _token_bytes(ranks)})
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def join(batches):
        flat = _flat(shared.value)
        for batch in batches:
            ids = [np.zeros(0, np.int32) if i.values is None else i.values.to_numpy(zero_copy_only=False) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_spelled(flat, ids)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, schema)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Number and digests of the ids of every text, and of the bytes they decode to.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``; for special rows
    see :func:`encode`.
    """
    tokens = _token_bytes(ranks)
    tables = {"decoded": tokens, "listed": [b"%d " % i for i in range(len(tokens))]}
    rows = _encoded(docs, ranks, pattern, HEAD, tables)
    # every numeral brings a space along
    listed = F.when(F.col("n_tokens") == 0, F.col("listed")).otherwise(F.expr("substring(listed, 1, length(listed) - 1)"))
    return rows.select("doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
