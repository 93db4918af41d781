"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import whole_runs
from .components import connected_components, joined
from .lineage import cut
from .textblocks import blocks, prefix_hash, span_hash, string_buffers

WINDOW = 8
LEAST_LEVEL = 3  # the least block size is 2**3 bytes
WANTED_CHUNKS = 32
GRAM = 7  # letters in a row that pairs usually must share elsewhere; no condition here, tests tell by it what that would lose
RUN = 3

_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.int64)
_CODE[_LETTERS] = np.arange(64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Cyclic-polynomial hash of the WINDOW bytes that end at each position, in three doublings."""
    h = _TABLE[data]
    for width in (1, 2, 4):
        turned = (h << np.uint32(width)) | (h >> np.uint32(32 - width))
        new = h.copy()
        new[width:] ^= turned[:-width]
        h = new
    return h * np.uint32(0x9E3779B1)


def block_levels(sizes: np.ndarray) -> np.ndarray:
    """log2 of each text's block size: the largest that leaves WANTED_CHUNKS chunks to expect, but 2**LEAST_LEVEL at least."""
    return np.maximum(LEAST_LEVEL, np.floor(np.log2(np.maximum(sizes, 1) / WANTED_CHUNKS))).astype(np.int64)


def _signatures(prefix: np.ndarray, cuts: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the chunks that end at cuts (sorted; each of the given row) and at row ends, and offsets by row."""
    ends = np.concatenate([cuts, offsets[1:]])
    rows = np.concatenate([row, np.arange(len(offsets) - 1)])
    by = np.lexsort((ends, rows))
    ends, rows = ends[by], rows[by]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    starts[first] = offsets[:-1][rows[first]]
    full = ends > starts
    starts, ends, rows = starts[full], ends[full], rows[full]
    letter = _LETTERS[(span_hash(prefix, starts, ends) >> np.uint64(58)).astype(np.int64)]
    # of longer runs of one letter, RUN letters stay
    keep = np.ones(len(letter), bool)
    same = np.zeros(len(letter), bool)
    same[1:] = (letter[1:] == letter[:-1]) & (rows[1:] == rows[:-1])
    deep = same.copy()
    for _ in range(RUN - 1):
        deep[1:] = deep[:-1] & same[1:]
        deep[0] = False
    keep = ~deep
    return letter[keep], np.searchsorted(rows[keep], np.arange(len(offsets)))


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Block levels of rows of bytes, and the letters of their signatures with offsets, at the level and at the next."""
    level = block_levels(np.diff(offsets))
    h = ~rolling_hash(data)
    at = np.flatnonzero((h & np.uint32((1 << LEAST_LEVEL) - 1)) == 0)
    depth = np.bitwise_count((h[at] & (~h[at] + np.uint32(1))) - np.uint32(1)).astype(np.int64)  # trailing ones of the hash
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at - offsets[row] >= WINDOW - 1
    at, depth, row = at[inside], depth[inside], row[inside]
    prefix = prefix_hash(data)
    out = []
    for more in (0, 1):
        hit = depth >= level[row] + more
        out.append(_signatures(prefix, at[hit] + 1, row[hit], offsets))
    return level, out[0], out[1]


def _strings(letters: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_size, signature, signature2): whole texts cut where the hash of the last 8 bytes ends in as many ones as
    the block size has zeros; a letter for each chunk's hash, at the block size and at twice it.

    Lengths are in UTF-8 bytes and signatures have no greatest length. A null text has a null block size and signatures, an
    empty one empty signatures. Ids may be null or repeat; other columns are ignored. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, valid = string_buffers(batch.column(1))
            for i, j in blocks(offsets):
                level, one, two = signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                no = ~valid[i:j]
                cols = [pa.array((1 << level).astype(np.int32)), _strings(*one), _strings(*two)]
                if no.any():
                    cols = [pa.array([None if n else v for n, v in zip(no, c.to_pylist())], c.type) for c in cols]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], ["doc_id", "block_size", "signature", "signature2"])

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, block_size int, signature string, signature2 string")


def common_letters(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, 64 positions of a at a time in machine words."""
    da, oa, _ = string_buffers(a)
    db, ob, _ = string_buffers(b)
    out = np.zeros(len(a), np.int64)
    la, lb = np.diff(oa), np.diff(ob)
    width = -(-la // 64)
    one, top = np.uint64(1), np.uint64(0)
    for w in np.unique(width[width > 0]):
        of_width = np.flatnonzero(width == w)
        for part in np.array_split(of_width, -(-len(of_width) * int(w) // 2048)):
            n = len(part)
            at = np.arange(n)
            masks = np.zeros((n, 64, w), np.uint64)
            for i in range(int(la[part].max())):
                on = np.flatnonzero(la[part] > i)
                masks[on, _CODE[da[oa[part[on]] + i]], i // 64] |= one << np.uint64(i % 64)
            v = np.full((n, w), ~top, np.uint64)
            for i in range(int(lb[part].max())):
                on = at[lb[part] > i]
                m = masks[on, _CODE[db[ob[part[on]] + i]]]
                carry = np.zeros(len(on), np.uint64)
                old = v[on]
                u = old & m
                new = np.empty_like(old)
                for k in range(int(w)):
                    s = old[:, k] + u[:, k]
                    over = s < old[:, k]
                    t = s + carry
                    over |= t < s
                    new[:, k] = t | (old[:, k] & ~m[:, k])
                    carry = over.astype(np.uint64)
                v[on] = new
            tail = la[part, None] - 64 * np.arange(w)[None, :]
            inside = np.where(tail >= 64, ~top, (one << np.clip(tail, 0, 63).astype(np.uint64)) - one)
            out[part] = np.bitwise_count(~v & inside).sum(1)
    return out


def compare(a: pa.Array, b: pa.Array) -> np.ndarray:
    """0 to 100 for pairs of signatures: 100 less the insertions and deletions between them, per hundred letters."""
    total = (pc.binary_length(a).to_numpy(zero_copy_only=False) + pc.binary_length(b).to_numpy(zero_copy_only=False)).astype(np.int64)
    return 200 * common_letters(a, b) // np.maximum(total, 1)


# --- all pairs, exactly ------------------------------------------------------------------------
#
# Two signatures have no more letters in common than both have. How often a signature has each of the 64 letters is kept in
# unary, a word for each of the first four times, so that letters both have are the popcount of an AND, and times beyond add no
# more than the lesser number of these. The letters in a row are compared where this bound leaves the score in reach. Of small cells all
# pairs are looked at so.

_TIMES = 4
_BYTE = 120  # signatures of up to so many letters are bounded in bytes

# Of larger cells few pairs are looked at. Let both signatures have two marks before their letters and two behind, which are in
# common too. Pairs in reach leave out so few letters between those in common that some four of these in a row, of which no outer
# mark is one, leave out _GAPS at most, both sides together; or else the first two after the marks leave out _GAPS_AHEAD, or the last
# two _GAPS_BEHIND, as else all of them left out too many (``_sure``). So each signature has a key for every four of its letters
# that leaves out so many, and pairs without a key in common aren't in reach.
_GAPS, _GAPS_AHEAD, _GAPS_BEHIND = 3, 2, 1
_MARKS = _OUTER_AHEAD, _AHEAD, _BEHIND, _OUTER_BEHIND = 64, 65, 66, 67
_CODES = 68
_STEPS = sorted(((d, sum(d) - 3) for d in product(range(1, _GAPS + 2), repeat=3) if sum(d) - 3 <= _GAPS), key=lambda x: x[1])
_LONG = 120  # letters of signatures that have keys; longer ones would have very many in common
_KEYS_PAY = 16_000  # rows to a side from which on keys cost less than all pairs
_BLOCK = 1 << 18  # rows whose keys are held at once
_CROWD = 1 << 10  # rows with one key from which on all of their pairs cost less than one by one
_CROWDED = 8  # times less
_MOST_MET = 8  # pairs to a meeting of keys from which on all pairs cost less
_MOST_HELD = 1 << 23  # links held at once


class _Side:
    """A column of signatures with what bounds their common letters, in order of length."""

    def __init__(self, column: pa.Array):
        data, offsets, _ = string_buffers(column)
        size = np.diff(offsets)
        self.order = np.argsort(size, kind="stable")
        self.column, self.code, self.start, self.size = column, _CODE[data].astype(np.uint8), offsets[:-1][self.order], size[self.order]
        words = np.empty((_TIMES, len(size)), np.uint64)
        for k in range(0, len(size), 1 << 13):
            part = offsets[k : k + (1 << 13) + 1]
            many = np.bincount(np.repeat(np.arange(len(part) - 1), np.diff(part)) * 64 + self.code[part[0] : part[-1]], minlength=64 * (len(part) - 1)).reshape(-1, 64)
            for time in range(_TIMES):
                words[time, k : k + len(part) - 1] = np.packbits(many > time, axis=1, bitorder="little").view(np.uint64)[:, 0]
        self.words = np.ascontiguousarray(words[:, self.order])
        own = np.bitwise_count(self.words).astype(np.int64)
        self.beyond = [self.size - own[:2].sum(0), self.size - own.sum(0)]
        self.bounds = {np.uint8: np.minimum(self.beyond[0], _BYTE).astype(np.uint8), np.uint32: self.beyond[0].astype(np.uint32)}

    def of(self, keep: np.ndarray) -> _Side:
        """The rows of the mask ``keep`` alone, by their row in the column."""
        return self.at(np.flatnonzero(keep[self.order]))

    def at(self, at: np.ndarray) -> _Side:
        """The rows at these places in order of length alone."""
        part = copy(self)
        part.order, part.start, part.size, part.words = self.order[at], self.start[at], self.size[at], np.ascontiguousarray(self.words[:, at])
        part.beyond, part.bounds = [b[at] for b in self.beyond], {kind: b[at] for kind, b in self.bounds.items()}
        return part


def _common(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray) -> np.ndarray:
    """Letters in common, in order, of each pair: ``common_letters``, with the masks of each x made once."""
    out = np.empty(len(i), np.int64)
    short = x.size[i] <= 64
    if not short.all():
        at = np.flatnonzero(~short)
        for k in range(0, len(at), 1 << 13):
            own = at[k : k + (1 << 13)]
            out[own] = common_letters(x.column.take(pa.array(x.order[i[own]])), y.column.take(pa.array(y.order[j[own]])))
    at = np.flatnonzero(short)
    if not len(at):
        return out
    rows, row = np.unique(i[at], return_inverse=True)
    one = np.uint64(1)
    code = np.append(y.code, np.uint8(64))
    for k in range(0, len(at), 1 << 13):
        own, at_row = at[k : k + (1 << 13)], row[k : k + (1 << 13)]
        first, last = int(at_row.min()), int(at_row.max()) + 1
        if last - first > 1 << 13:  # a mask for each pair would be less
            used, at_row = np.unique(at_row, return_inverse=True)
        else:
            used, at_row = np.arange(first, last), at_row - first
        used = rows[used]
        masks = np.zeros((len(used), 65), np.uint64)
        for pos in range(int(x.size[used].max(initial=0))):
            on = np.flatnonzero(x.size[used] > pos)
            masks[on, x.code[x.start[used[on]] + pos]] |= one << np.uint64(pos)
        masks, base = masks.ravel(), at_row * 65
        v = np.full(len(own), ~np.uint64(0), np.uint64)
        size, start = y.size[j[own]], y.start[j[own]]
        for pos in range(int(size.max(initial=0))):
            m = masks[base + code[np.where(size > pos, start + pos, -1)]]
            u = v & m
            v = (v + u) | (v - u)
        length = x.size[i[own]]
        inside = np.where(length >= 64, ~np.uint64(0), (one << np.minimum(length, 63).astype(np.uint64)) - one)
        out[own] = np.bitwise_count(~v & inside)
    return out


def _within_reach(x: _Side, y: _Side, min_score: int, once: bool = False, width: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), in order of length, of the pairs of rows of x and y that could reach ``min_score``; those with i < j if ``once``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    need, need_of = np.zeros(0), -1
    common, other, ways = np.empty(width, np.uint8), np.empty(width, np.uint8), np.empty(width, np.uint64)
    for i in range(len(x.size)):
        size = int(x.size[i])
        if size != need_of:
            # score = 200 * common // both sizes, so common letters must be this many; more than either has can't be
            need, need_of = -(-min_score * (size + y.size) // 200), size
            fits = np.flatnonzero(np.minimum(size, y.size) >= need)
            low, high = (int(fits[0]), int(fits[-1]) + 1) if len(fits) else (0, 0)
            kind = np.uint8 if size <= _BYTE else np.uint32
            need = np.minimum(need, np.iinfo(kind).max).astype(kind)
            beyond = y.bounds[kind]
        own = x.bounds[kind][i]
        for at in range(max(low, i + 1) if once else low, high, width):
            end = min(at + width, high)
            n = end - at
            np.bitwise_and(y.words[0, at:end], x.words[0, i], out=ways[:n])
            np.bitwise_count(ways[:n], out=common[:n])
            np.bitwise_and(y.words[1, at:end], x.words[1, i], out=ways[:n])
            np.bitwise_count(ways[:n], out=other[:n])
            np.add(common[:n], other[:n], out=common[:n])
            j = np.flatnonzero(common[:n] + np.minimum(beyond[at:end], own) >= need[at:end])
            if len(j):
                held.append((np.full(len(j), i), j + at))
                total += len(j)
        if total > 1 << 18:
            yield _closer(held, x, y, min_score)
            held, total = [], 0
    if held:
        yield _closer(held, x, y, min_score)


def _closer(held: list[tuple[np.ndarray, np.ndarray]], x: _Side, y: _Side, min_score: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(c) for c in zip(*held))
    most = np.minimum(x.beyond[1][i], y.beyond[1][j])
    for time in range(_TIMES):
        most = most + np.bitwise_count(x.words[time, i] & y.words[time, j])
    near = 200 * most >= min_score * (x.size[i] + y.size[j])
    return i[near], j[near]


@cache
def _sure(min_score: int) -> bool:
    """Whether any two signatures of up to ``_LONG`` letters that score ``min_score`` have a key in common."""
    both = np.arange(2, 2 * _LONG + 1)
    need = np.maximum(1, -(-min_score * both // 200))
    # need + 1 gaps: three to a key without outer marks; one or two over are left to the keys at the ends
    keys, over = np.divmod(need + 1, 3)
    least = (_GAPS + 1) * keys
    one = least - (_GAPS + 1) + _GAPS_AHEAD + 1 + _GAPS_BEHIND + 1
    two = least + max(_GAPS_AHEAD, _GAPS_BEHIND) + 1
    least = np.where(over == 0, least, np.where(over == 1, np.maximum(least, one), two))
    return bool((least > both - 2 * need).all())


class _Keys:
    """The keys of a side's rows, by their first letter."""

    def __init__(self, side: _Side):
        n = len(side.size)
        wide = side.size + len(_MARKS)
        first = np.cumsum(wide) - wide
        self.row = np.repeat(np.arange(n, dtype=np.uint32), wide)
        self.code = np.full(len(self.row) + _GAPS + 3, _OUTER_BEHIND, np.uint8)
        for mark, at in ((_OUTER_AHEAD, first), (_AHEAD, first + 1), (_BEHIND, first + wide - 2)):
            self.code[at] = mark
        # letters from each to the inner mark behind
        self.last = (np.repeat((first + wide - 2).astype(np.int32), wide) - np.arange(len(self.row), dtype=np.int32)).astype(np.int8)
        place = np.arange(side.size.sum(), dtype=np.int32) - np.repeat((np.cumsum(side.size) - side.size).astype(np.int32), side.size)
        self.code[place + np.repeat(first + 2, side.size)] = side.code[place + np.repeat(side.start, side.size)]

    def of(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys that begin with the letter (the other three, and how many letters are left out) and their rows, in order of both."""
        at = np.flatnonzero(self.code[: len(self.row)] == letter)
        row, last = self.row[at].astype(np.uint64), self.last[at]
        ahead = letter == _OUTER_AHEAD
        here = [self.code[at + d].astype(np.uint32) for d in range(1, _GAPS + 4)]
        found = []
        for (a, b, c), gaps in _STEPS:
            if ahead and (a > 1 or gaps > _GAPS_AHEAD):
                continue
            # the outer mark behind follows the inner one
            behind = not ahead and c == 1 and gaps <= _GAPS_BEHIND
            on = np.flatnonzero(last >= a + b + c - behind)
            key = here[a - 1][on]
            for d in (a + b, a + b + c):
                key *= np.uint32(_CODES)
                key += here[d - 1][on]
            key *= np.uint32(_GAPS + 1)
            key += np.uint32(gaps)
            found.append(key.astype(np.uint64) << np.uint64(32) | row[on])
        packed = np.concatenate(found)
        packed.sort()
        return (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _met(x: _Side, y: _Side, same: bool, most: int, stretch: int = 1 << 18, width: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(i, j, whole) of rows of x and y that have a key in common: pairs, for each key, or sets of which all pairs have one if
    ``whole``. Of one table, if ``same``, a pair comes one way round. Once that is more work than ``most`` pairs, empty ones and no more."""
    keys = _Keys(x)
    others = keys if same else _Keys(y)
    many = _CODES**3
    crowds_held = [(np.zeros(len(x.size), bool), np.zeros(len(y.size), bool))]
    for letter in range(_BEHIND):
        k_y, r_y = others.of(letter)
        k_x, r_x = (k_y, r_y) if same else keys.of(letter)
        if not len(k_x) or not len(k_y):
            continue
        start = np.zeros((many + 1) * (_GAPS + 1) + 1, np.int64)
        np.cumsum(np.bincount(k_y, minlength=len(start) - 1), out=start[1:])
        allowed = _GAPS_AHEAD if letter == _OUTER_AHEAD else _GAPS
        crowds = np.flatnonzero(np.diff(start[:: _GAPS + 1]) >= _CROWD)
        for base in (crowds * (_GAPS + 1)).tolist():
            rows_y = np.unique(r_y[start[base] : start[base + _GAPS + 1]]).astype(np.intp)
            rows_x = rows_y if same else np.unique(r_x[slice(*np.searchsorted(k_x, np.array([base, base + _GAPS + 1], np.uint32)))]).astype(np.intp)
            most -= len(rows_x) * len(rows_y) // _CROWDED
            if most < 0:
                break
            # crowds of several keys are much the same rows: what an earlier one held already is left out
            held = max(crowds_held, key=lambda c: np.count_nonzero(c[0][rows_x]) + np.count_nonzero(c[1][rows_y]))
            old_x, old_y = held[0][rows_x], held[1][rows_y]
            sets = [(rows_x[~old_x], rows_y)] + ([] if same else [(rows_x[old_x], rows_y[~old_y])])
            for part_x, part_y in sets:
                if len(part_x) and len(part_y):
                    yield part_x, part_y, True
            if not old_x.all() or not old_y.all():
                mark = np.zeros(len(x.size), bool), np.zeros(len(y.size), bool)
                mark[0][rows_x] = mark[1][rows_y] = True
                crowds_held = [crowds_held[0], *crowds_held[1:][-7:], mark]
        for at in range(0, len(k_x), stretch):
            key = k_x[at : at + stretch].astype(np.intp)
            gaps = key & _GAPS
            base = key - gaps
            # those of one table with gaps no less than one's own lie behind it
            low = np.arange(at + 1, at + 1 + len(key)) if same else start[base]
            count = start[base + (allowed + 1) - gaps] - low
            if len(crowds):
                count[np.isin(key // (_GAPS + 1), crowds)] = 0
            on = np.flatnonzero(count > 0)
            low, count, row = low[on], count[on], r_x[at + on].astype(np.intp)
            total = np.concatenate([[0], np.cumsum(count)])
            most -= int(total[-1])
            if most < 0:
                yield row[:0], row[:0], False
                return
            k = 0
            while k < len(on):
                end = max(k + 1, int(np.searchsorted(total, total[k] + width, "right")) - 1)
                n = count[k:end]
                i = np.repeat(row[k:end], n)
                j = r_y[np.arange(len(i)) + np.repeat(low[k:end] - (total[k:end] - total[k]), n)].astype(np.intp)
                if same:
                    apart = np.flatnonzero(i != j)
                    i, j = i[apart], j[apart]
                if len(i):
                    yield i, j, False
                k = end


def _links_by_keys(x: _Side, y: _Side, min_score: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, score) of the pairs of rows of the columns of x and y that score ``min_score``, of one table those with i < j; None where
    all pairs cost less."""
    m = len(y.size)
    done, score, held, total = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    need = (-(-min_score * np.arange(2 * _LONG + 1) // 200)).astype(np.uint8)
    beyond = [s.beyond[0].astype(np.uint8) for s in (x, y)]
    sizes = [s.size.astype(np.uint8) for s in (x, y)]

    def take() -> None:
        nonlocal done, score, total
        pair = np.unique(np.concatenate(held))
        held.clear()
        total = 0
        if len(done):
            at = np.minimum(np.searchsorted(done, pair), len(done) - 1)
            pair = pair[done[at] != pair]
        i, j = pair // m, pair % m
        value = 200 * _common(x, i, y, j) // (x.size[i] + y.size[j])
        good = value >= min_score
        done, score = np.concatenate([done, pair[good]]), np.concatenate([score, value[good]])
        by = np.argsort(done, kind="stable")
        done, score = done[by], score[by]

    def hold(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal total
        held.append(np.minimum(i, j) * m + np.maximum(i, j) if same else i * m + j)
        total += len(i)
        if total > 1 << 21:
            take()

    for i, j, whole in _met(x, y, same, len(x.size) * m // _MOST_MET):
        if not len(i) or len(done) > _MOST_HELD:
            return None
        if whole:
            for a, b in _within_reach(x.at(i), y.at(j), min_score, same and len(i) == len(j)):
                a, b = i[a], j[b]
                if same:
                    apart = a != b
                    a, b = a[apart], b[apart]
                hold(a, b)
            continue
        most = np.minimum(beyond[0].take(i), beyond[1].take(j))
        for time in range(2):
            both = x.words[time].take(i)
            both &= y.words[time].take(j)
            most += np.bitwise_count(both)
        near = np.flatnonzero(most >= need.take(sizes[0].take(i) + sizes[1].take(j)))
        if len(near):
            hold(*_closer([(i[near], j[near])], x, y, min_score))
    if held:
        take()
    i, j = x.order[done // m], y.order[done % m]
    return (np.minimum(i, j), np.maximum(i, j), score) if same else (i, j, score)


def _links(x: list[_Side], y: list[_Side], min_score: int, same: bool, pairs: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of all pairs of rows of x and y of which one of the sides scores ``min_score`` or more, each once, with its
    best score; of pairs of rows of one table, if ``same``, those with i < j. Some rows at a time, so that few links are held."""
    n, m = len(x[0].size), len(y[0].size)
    row, other = np.arange(n), np.arange(m)

    def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, score = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((-score, j, i))
        i, j, score = i[by], j[by], score[by]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        return i[first], j[first], score[first]

    def of_all(a: _Side, b: _Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j in _within_reach(a, b, min_score):
            if same:
                ahead = a.order[i] < b.order[j]
                i, j = i[ahead], j[ahead]
            score = 200 * _common(a, i, b, j) // np.maximum(a.size[i] + b.size[j], 1)
            good = score >= min_score
            yield a.order[i[good]], b.order[j[good]], score[good]

    def by_keys(a: _Side, b: _Side, one: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        short = [s.at(np.flatnonzero((s.size > 0) & (s.size <= _LONG))) for s in (a, b)]
        found = _links_by_keys(*short, min_score, one)
        if found is None:
            return None
        long = [s.at(np.flatnonzero(s.size > _LONG)) for s in (a, b)]
        return [found, *of_all(long[0], b), *of_all(short[0], long[1])]

    if n * m < _KEYS_PAY**2 or not _sure(min_score):
        blocks = [(0, n, 0, m)]
    else:
        blocks = [(k, min(n, k + _BLOCK), h, min(m, h + _BLOCK)) for k in range(0, n, _BLOCK) for h in range(k if same else 0, m, _BLOCK)]
    for low, high, start, end in blocks:
        if (high - low) * (end - start) >= _KEYS_PAY**2 and _sure(min_score):
            found = []
            for a, b in zip(x, y):
                a, b = a.of((row >= low) & (row < high)), b.of((other >= start) & (other < end))
                some = by_keys(a, b, same and low == start)
                if some is None:
                    break
                found += some
            else:
                yield best(found)
                continue
        step = max(1, pairs // (end - start))
        for k in range(low, high, step):
            found = []
            for a, b in zip(x, y):
                a = a.of((row >= k) & (row < min(k + step, high)))
                b = b.of((other >= start) & (other < end) & (other > k if same else True))
                found += of_all(a, b)
            if found:
                yield best(found)


def _found_in_cell(half: np.ndarray, node: np.ndarray, one: np.ndarray, second: pa.Array, columns: list[pa.Array], min_score: int) -> pa.RecordBatch:
    """(node, tied, n, other, score): n links of the node in the cell, ``tied`` the least row that they reach, and its best match."""
    size = len(node)
    label, count = np.arange(size), np.zeros(size, np.int64)
    best, arg = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    two, more = pc.fill_null(second, 0).to_numpy(), pc.is_valid(second).to_numpy(zero_copy_only=False)
    at_x, at_y = np.flatnonzero(half <= 1), np.flatnonzero((half == 0) | (half == 2))
    same = len(at_x) > 0 and half[at_x[0]] == 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take() -> None:
        a, b, score = (np.concatenate(c) for c in zip(*held))
        held.clear()
        joined(label, a, b)
        np.add.at(count, a, 1)
        np.add.at(count, b, 1)
        who, of, score = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
        own = one[who] == one[of]
        other, there = np.where(own, two[of], one[of]), ~own | more[of]
        who, other, score = who[there], other[there], score[there]
        order = np.lexsort((other, -score, who))
        who, other, score = who[order], other[order], score[order]
        first = np.ones(len(who), bool)
        first[1:] = who[1:] != who[:-1]
        who, other, score = who[first], other[first], score[first]
        better = (score > best[who]) | ((score == best[who]) & (other < arg[who]))
        best[who[better]], arg[who[better]] = score[better], other[better]

    if len(at_x) and len(at_y):
        x = [_Side(c.take(pa.array(at_x))) for c in columns]
        y = x if same else [_Side(c.take(pa.array(at_y))) for c in columns]
        for i, j, score in _links(x, y, min_score, same):
            held.append((at_x[i], at_y[j], score))
            if sum(len(h[0]) for h in held) > 1 << 18 or len(held) > 1 << 10:
                take()
        if held:
            take()
    some = np.flatnonzero(count > 0)
    none = best[some] < 0
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(count[some]), pa.array(arg[some], mask=none), pa.array(best[some].astype(np.int32), mask=none)], ["node", "tied", "n", "other", "score"])


def class_links(classes: DataFrame, min_score: int = 60, block_rows: int = 3 << 18, least_rows: int = 1 << 17, least_blocks: int = 4) -> DataFrame:
    """(node, tied, n, other, score) among classes (node, one, second, block_size, signature, signature2) of different fingerprints.

    Every pair with a score of ``min_score`` or more is a link. The n of a node sum up to its links; pairs (node, tied) span them; the
    greatest score, then the least ``other``, is the document most alike: of a class its ``one``, or the ``second`` where that is the
    node's own ``one``, as an id may have several texts. Signatures are compared where block sizes
    agree: both own ones, both double ones, or one's own with the other's double, and the best score counts.

    Classes of a block size are spread over blocks. Each pair of blocks of one size, or of one and its double, is a task's cell, so no
    task holds more than two blocks. In small cells all pairs are looked at, in larger ones those that have a key in common.
    """
    sizes = sorted((r["block_size"], r["count"]) for r in classes.groupBy("block_size").count().collect())
    many = [max(min(least_blocks, -(-n // least_rows)), -(-n // block_rows)) for _, n in sizes]
    start = [sum(many[:k]) for k in range(len(many))]
    total = max(1, sum(many))
    span = {}
    for k, (size, _) in enumerate(sizes):
        before = k > 0 and 2 * sizes[k - 1][0] == size
        after = k + 1 < len(sizes) and 2 * size == sizes[k + 1][0]
        span[size] = (start[k], many[k], start[k - 1] if before else start[k], start[k] + many[k] + (many[k + 1] if after else 0) - 1)
    cells = sum(1 for a, b in ((i, j) for i in range(total) for j in range(i, total)) if any(s <= a < s + m and b <= high for s, m, _, high in span.values()))

    def of_size(which: int) -> Column:
        return F.coalesce(*(F.when(F.col("block_size") == size, F.lit(v[which])) for size, v in span.items()), F.lit(0))

    own = (of_size(0) + F.pmod(F.xxhash64("node"), of_size(1))).cast("int").alias("own")
    near = F.sequence(of_size(2), of_size(3))
    placed = classes.select("*", own, of_size(0).alias("start"), (of_size(0) + of_size(1)).alias("end"), F.explode(near).alias("with"))
    half = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).cast("byte")
    alike = (F.col("with") >= F.col("start")) & (F.col("with") < F.col("end"))
    text = F.when(alike | (F.col("own") > F.col("with")), F.col("signature")).otherwise(F.col("signature2"))
    rows = placed.select((F.least("own", "with") * total + F.greatest("own", "with")).alias("cell"), half.alias("half"), "node", "one", "second", text.alias("s"), F.when(alike, F.col("signature2")).alias("s2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            cell = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for i, j in zip(ends, ends[1:]):
                part = batch.slice(i, j - i)
                half, node, one = (part.column(c).to_numpy() for c in (1, 2, 3))
                yield _found_in_cell(half, node, one, part.column(4), [part.column(c) for c in (5, 6) if not part.column(c).null_count], min_score)

    return rows.repartition(max(1, cells), "cell").sortWithinPartitions("cell").mapInArrow(run, "node long, tied long, n long, other long, score int")


def best_matches(prints: DataFrame, min_score: int = 60, cell_rows: int = 3 << 18) -> DataFrame:
    """(doc_id, other, score): for each of prints (doc_id, block_size, signature, signature2) the ones most alike by ``class_links``;
    a document may come several times, its row of greatest score and least other counts."""
    classes = cut(prints.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").alias("one"), F.lit(None).cast("long").alias("second"), "block_size", "signature", "signature2"))
    links = class_links(classes, min_score, cell_rows).where("other IS NOT NULL")
    return links.join(classes.select("node", F.col("one").alias("doc_id")), "node").select("doc_id", "other", "score")


def fingerprint_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: int = 60) -> DataFrame:
    """(doc_id, block_size, signature, signature2, match_id, score, group_id, n_links) for every row with an id and a text.

    Documents with equal fingerprints are a class. Two classes are linked where they score ``min_score`` or more, whatever their
    signatures' lengths (``class_links``): ``n_links`` counts the classes that a document's is linked to, and ``group_id`` is the least
    id of all that links connect. ``match_id`` is the document most alike, the least id among equals; null where there is none.
    Documents of one class match each other at 100, and only the class is compared, so copies, however many, add nothing to the
    search. Texts without a signature match nothing. Rows that repeat an id and a text are one; an id isn't its own match.
    """
    prints = cut(fingerprint_documents(docs.where(F.col(id_col).isNotNull()), id_col, text_col).where("block_size IS NOT NULL").distinct())
    key = ["block_size", "signature", "signature2"]
    some = prints.where("signature <> ''")
    classes = cut(some.groupBy(*key).agg(F.min("doc_id").alias("one")).select(F.monotonically_increasing_id().alias("node"), "one", *key))
    member = cut(some.join(classes, key).select("doc_id", *key, "node", "one"))
    second = cut(member.where("doc_id <> one").groupBy("node").agg(F.min("doc_id").alias("second")))
    classes = classes.join(second, "node", "left")
    links = cut(class_links(classes, min_score))
    groups = connected_components(links.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    named = groups.join(classes.select("node", "one"), "node")
    named = named.join(named.groupBy("component").agg(F.min("one").alias("group_id")), "component").select("node", "group_id")
    found = links.groupBy("node").agg(F.sum("n").cast("int").alias("n_links"), F.min_by("other", F.when(F.col("other").isNotNull(), F.struct(-F.col("score"), "other"))).alias("other"), F.max("score").alias("near"))
    rows = member.join(found.join(named, "node"), "node", "left").join(second, "node", "left")
    twin = F.when(F.col("doc_id") != F.col("one"), F.col("one")).otherwise(F.col("second"))
    other = F.when(F.col("other") != F.col("doc_id"), F.col("other"))
    as_copy = twin.isNotNull() & (other.isNull() | (F.col("near") < 100) | (twin < other))
    match, score = F.when(as_copy, twin).otherwise(other), F.when(as_copy, 100).when(other.isNotNull(), F.col("near"))
    rows = rows.select("doc_id", *key, match.alias("match_id"), score.cast("int").alias("score"), F.coalesce("group_id", "one").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    bare = prints.where("signature = ''").select("doc_id", *key, F.lit(None).cast("long").alias("match_id"), F.lit(None).cast("int").alias("score"), F.col("doc_id").alias("group_id"), F.lit(0).alias("n_links"))
    return rows.unionByName(bare)
