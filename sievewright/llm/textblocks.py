"""Vectorised views over Arrow string columns.

Every text operator here walks Arrow batches in blocks of whole rows, about ``BLOCK_BYTES`` of
UTF-8 at a time, so that memory stays flat however large a batch is and the arrays stay in cache.
A single row longer than a block forms a block of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n+1 offsets into them, and a validity mask; nulls become zero-length rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), bool)
    if column.null_count:
        valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if not pa.types.is_binary(column.type) else column.cast(kind)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return raw, offsets - offsets[0], valid


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``size`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
    up, down = np.full(n, _MULT, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, for at least n positions."""
    return _powers(1 << max(20, int(n).bit_length()))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (values[t] + 1) * base**t for t < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span [start, end); equal spans hash alike wherever they stand."""
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at row offsets too."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    start[edge] = mask[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = mask[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word (ASCII-lowered run of letters, digits and non-ASCII bytes), its byte start, and n+1 word offsets by row."""
    start, end = runs(_WORD[data], offsets)
    hashes = span_hash(prefix_hash(_LOWER[data]), start, end) if len(start) else np.zeros(0, np.uint64)
    return hashes, start, np.searchsorted(start, offsets)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i+1]); empty segments give 0."""
    total = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return total
