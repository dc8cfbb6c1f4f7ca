"""A bitmap of fixed size that tells which keys may be in a table.

It saves tasks from sending rows that a later join would drop. Its size does not
grow with the table; where the table is too large for it, it lets more rows
through, and the join still decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.text_hashes import mix


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.view(np.uint64) + np.uint64(5)) & np.uint64(bits - 1)).astype(np.int64)


class KeyFilter:
    """The bitmap of the long column ``key`` of ``df``, with ``bits`` bits, a power of two."""

    def __init__(self, df: DataFrame, bits: int):
        def mark(batches):
            for batch in batches:
                places = np.unique(_places(keys_of(batch.column("key")), bits))
                words, inverse = np.unique(places >> 6, return_inverse=True)
                values = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(values, inverse, np.uint64(1) << (places & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], names=["word", "value"])

        marked = df.select("key").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
        found = marked.toPandas()
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[found["word"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64).view(np.uint64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        places = _places(keys, self.bits)
        return ((self.words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def keys_of(column) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def maybe(df: DataFrame, known: KeyFilter, column: str, held: bool = True) -> DataFrame:
    """Rows whose ``column`` may be among the keys, or those where it surely is not."""

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array(known.may_hold(keys_of(batch.column(column))) == held))

    return df.mapInArrow(passing, df.schema)
