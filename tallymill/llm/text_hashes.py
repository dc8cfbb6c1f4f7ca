"""Words, word hashes and shingles of Arrow string columns, with numpy.

Words are runs of bytes other than space and 0x09-0x0D. Hashes ignore the case
of A-Z. All hashes are 64 bits wide and the same on every machine and in every
run; two different words share one with a probability of about 2**-64.

Texts are worked on in chunks of about ``CHUNK`` bytes, so that memory is
bounded by the longest text and not by an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; only a longer single text exceeds it.
CHUNK = 1 << 18

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every bit depends on every other one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def _power(kind: str, n: int) -> np.ndarray:
    known = _powers.get(kind)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        known[0] = 1
        _powers[kind] = known = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def give_back() -> None:
    """Return freed memory to the system; a worker lives on beside what the JVM does next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind one another, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # workers are used again for other stages, which need what earlier batches took
    pa.default_memory_pool().release_unused()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to ``size`` bytes, or one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the number of words before each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_BREAKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words before each row."""
    starts, ends, words = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), words
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * _power("up", len(data)), out=total[1:])
    value = (total[ends] - total[starts]) * _power("down", len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64)), words


def windows(hashes: np.ndarray, rows: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for every run of ``width`` neighbours inside a row.

    Returns the hashes, the position of each run's first element, and the
    number of runs before each row. A shorter row has none.
    """
    counts = np.maximum(np.diff(rows) - width + 1, 0)
    before = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=before[1:])
    at = np.arange(before[-1]) + np.repeat(rows[:-1] - before[:-1], counts)
    total = np.zeros(len(at), np.uint64)
    for j, factor in enumerate(constants(width, seed)):
        total += hashes[at + j] * factor
    return mix(total), at, before


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, and the number before each row.

    A row of fewer than ``width`` words has its whole sequence as one shingle;
    a row without words has none.
    """
    runs, _, before = windows(hashes, rows, width, 7)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(before))
    n = np.diff(rows)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        factors = constants(width, 8)
        whole = np.zeros(len(short), np.uint64)
        for j in range(width):
            has = n[short] > j
            whole[has] += hashes[rows[short[has]] + j] * factors[j]
        runs = np.concatenate([runs, mix(whole + n[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    runs, row = runs[fresh], row[fresh]
    return runs, np.searchsorted(row, np.arange(len(rows)))


def binaries(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The numbers of each row as one binary value."""
    flat = np.ascontiguousarray(values)
    places = (rows * flat.itemsize).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(flat.tobytes())]
    )
    return large.cast(pa.binary())
