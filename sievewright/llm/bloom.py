"""A Bloom filter over the longs of a column, of bounded size: it thins what a join shuffles and decides nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import mix64

BITS_A_KEY, PROBES = 16, 4


def _positions(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.view(np.uint64)
    for i in range(PROBES):
        yield mix64(h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1))) & np.uint64(bits - 1)


def build(keys: DataFrame, count: int, most_bits: int = 1 << 28) -> np.ndarray:
    """The filter's words, of about ``count`` keys in the only column of ``keys``; at most ``most_bits``, 32 MB.

    With more keys than these bits suit, more of what isn't wanted passes, never less of what is. Words are made on the
    executors and combined before they reach the driver.
    """
    bits = min(most_bits, 1 << max(16, (BITS_A_KEY * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_positions(batch.column(0).to_numpy(), bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "value"])

    found = keys.mapInArrow(run, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(bits >> 6, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64).view(np.uint64)
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True for every key that was put in, and for few others."""
    out = np.ones(len(keys), bool)
    for at in _positions(keys, len(words) << 6):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
