"""SimHash near-duplicate groups: an exact join within a Hamming distance by parts of bits, or a sampled one over segment popcounts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import meet_in_cells, strips, whole_runs
from .components import connected_components, joined
from .lineage import cut
from .textblocks import blocks, mix64, segment_sum, string_buffers, words

WORDS64 = 4
BITS = 64 * WORDS64

_SPREAD = np.zeros(256, np.uint64)
for _v in range(256):
    _SPREAD[_v] = sum(1 << (8 * _b) for _b in range(8) if _v >> _b & 1)
_LANES = [np.uint64((0xA0761D6478BD642F * (2 * i + 1)) & (2**64 - 1)) for i in range(WORDS64)]


def _votes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row and bit, how many of the row's hashes have that bit set."""
    sizes = np.diff(offsets)
    parts = (sizes + 254) // 255  # byte counters hold up to 255 votes
    row = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = offsets[:-1][row] + 255 * nth
    per_row = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros((len(sizes), BITS), np.int32)
    if not len(cuts):
        return out
    for lane, salt in enumerate(_LANES):
        lanes = mix64(hashes ^ salt).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts = np.add.reduceat(_SPREAD[lanes[:, byte]], cuts)
            wide = counts.view(np.uint8).reshape(-1, 8).astype(np.int32)
            at = lane * 64 + byte * 8
            out[:, at : at + 8] = segment_sum(wide, per_row)
    return out


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 fingerprints over each text's set of words, and which rows have one.

    A text without words votes with one hash of its bytes, so that only exact copies match it;
    an empty or null text has no fingerprint.
    """
    data, offsets, valid = string_buffers(column)
    out = np.zeros((len(valid), WORDS64), np.uint64)
    for i, j in blocks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, _, at = words(part, off)
        row = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(at))
        bare = np.flatnonzero((np.diff(at) == 0) & (np.diff(off) > 0))
        if len(bare):
            whole = [np.uint64(int.from_bytes(blake2b(part[off[b] : off[b + 1]].tobytes(), digest_size=8).digest(), "little")) for b in bare]
            row, hashes = np.concatenate([row, bare.astype(np.uint64)]), np.concatenate([hashes, np.array(whole, np.uint64)])
        # one vote for each distinct word: 24 bits of row, 40 of hash
        keys = np.unique(row << np.uint64(40) | hashes >> np.uint64(24))
        ends = np.searchsorted(keys >> np.uint64(40), np.arange(j - i + 1, dtype=np.uint64))
        votes = _votes(keys & np.uint64((1 << 40) - 1), ends)
        bits = votes * 2 > np.diff(ends)[:, None]
        out[i:j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out, valid & (np.diff(offsets) > 0)


# --- the embedding -----------------------------------------------------------------------------
#
# A fingerprint is cut into 2-bit segments; a segment's popcount is 0, 1 or 2. The Manhattan
# distance of two popcount vectors never exceeds the Hamming distance of the fingerprints.
# Popcounts are kept in unary in place (01 for one, 11 for two), so that Manhattan distance is
# the popcount of an XOR, and a grid cell is the code under a mask.

SEGMENTS = BITS // 2
_ODD = 0x5555555555555555


def embed(fp: np.ndarray) -> np.ndarray:
    """Unary popcounts of the 2-bit segments of (n, 4) fingerprints."""
    odd, high = np.uint64(_ODD), fp >> np.uint64(1)
    return ((fp | high) & odd) | ((fp & high & odd) << np.uint64(1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache
def grids(count: int, segments: int, seed: int = 7) -> list[list[int]]:
    """For each grid the four 64-bit masks over the segments that it reads, as signed longs.

    Segments are dealt round by round from shuffled decks, so that grids overlap as little as they can.
    """
    rng, deck, out = np.random.default_rng(seed), [], []
    for _ in range(count):
        own: list[int] = []
        while len(own) < segments:
            if not deck:
                deck = [int(x) for x in rng.permutation(SEGMENTS) if x not in own]
            own.append(deck.pop())
        masks = [0] * WORDS64
        for s in own:
            masks[s // 32] |= 3 << 2 * (s % 32)
        out.append([_signed(m) for m in masks])
    return out


def segments_for(rows: int) -> int:
    """Segments of a grid, so that a cell holds about 1000 of so many unrelated rows: 3/8 of them agree in a segment. At least 8."""
    return max(8, math.ceil(math.log(max(rows, 1) / 1000) / math.log(8 / 3)))


def grids_for(segments: int, distance: int, recall: float = 0.99) -> int:
    """Grids that pairs ``distance`` bits apart need to meet in one of them with this chance or more.

    Counted are grids whose segments hold no differing bit; those in which differences cancel come on top.
    """
    meet = math.comb(BITS - distance, 2 * segments) / math.comb(BITS, 2 * segments)
    if not meet:
        raise ValueError("max_distance leaves no segments to agree in")
    return 1 if meet == 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))


_FP = [f"f{i}" for i in range(WORDS64)]


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, f0..f3) of every row with an id and a non-empty text; t is the text's hash. One narrow pass; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, has = fingerprints(batch.column(2))
            fp, keep = fp[has].view(np.int64), pa.array(has)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), *(pa.array(fp[:, i]) for i in range(WORDS64))], ["doc_id", "t", *_FP])

    text = F.col(text_col).cast("string")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).where("doc_id IS NOT NULL")
    return thin.mapInArrow(run, "doc_id long, t long, " + ", ".join(f"{f} long" for f in _FP))


def _links_in_cells(cols: list[np.ndarray], half: np.ndarray, limit: int, masks: np.ndarray) -> list[np.ndarray]:
    """(a, b, n): b is the least row that a reaches in its cell over pairs within ``limit``, n how many of these pairs a is of.

    All pairs of a cell are looked at: Manhattan bound first, exact distance after. A pair counts in the first grid only in
    which it meets, so that sums of n over all cells count each pair once.
    """
    cell, grid, ids = cols[:3]
    fp = np.ascontiguousarray(np.stack(cols[3:], 1)).view(np.uint64)
    code = embed(fp)
    n = len(cell)
    label, count = np.arange(n), np.zeros(n, np.int64)
    for a, b in strips(np.searchsorted(cell, cell, "right") - np.arange(n) - 1):
        if half.any():
            meet = (half[a] == 0) | (half[a] != half[b])
            a, b = a[meet], b[meet]
        near = np.bitwise_count(code[a] ^ code[b]).sum(1, dtype=np.int32) <= limit
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int32) <= limit
        a, b = a[near], b[near]
        if not len(a):
            continue
        joined(label, a, b)
        differ, new = code[a] ^ code[b], np.ones(len(a), bool)
        for g in range(int(grid[a].max())):
            new &= (grid[a] <= g) | (differ & masks[g]).any(1)
        count += np.bincount(a[new], minlength=n) + np.bincount(b[new], minlength=n)
    some = np.flatnonzero((label != np.arange(n)) | (count > 0))
    return [ids[some], ids[label[some]], count[some]]


def near_links(unique: DataFrame, max_distance: int, grid_count: int, grid_segments: int, cell_rows: int = 1 << 14) -> DataFrame:
    """(a, b, n) among rows (doc_id, f0..f3) of different fingerprints; a sampled join (``all_links`` is the exact one).

    Each row is placed in ``grid_count`` grids; a shuffle brings the rows of a cell together, and all of its pairs are verified.
    Pairs (a, b) span each cell's near pairs, no more of them than rows; the n of a row sum up to the near rows it has.
    """
    high = [F.shiftrightunsigned(f, 1) for f in _FP]
    code = [F.col(f).bitwiseOR(h).bitwiseAND(F.lit(_ODD)).bitwiseOR(F.shiftleft(F.col(f).bitwiseAND(h).bitwiseAND(F.lit(_ODD)), 1)).alias(f"c{i}") for i, (f, h) in enumerate(zip(_FP, high))]
    own = grids(grid_count, grid_segments)
    cells = [F.xxhash64(F.lit(g), *(F.col(f"c{i}").bitwiseAND(F.lit(m)) for i, m in enumerate(masks) if m)) for g, masks in enumerate(own)]
    placed = unique.select("doc_id", *_FP, *code).select("doc_id", *_FP, F.posexplode(F.array(*cells)).alias("grid", "cell"))
    masks = np.array(own, np.int64).view(np.uint64)

    def compare(cols: list[np.ndarray], half: np.ndarray) -> list[np.ndarray]:
        return _links_in_cells(cols, half, max_distance, masks)

    return meet_in_cells(placed.select("cell", "grid", "doc_id", *_FP), compare, ("a", "b", "n"), cell_rows)


# --- all pairs, exactly ------------------------------------------------------------------------
#
# Cut a fingerprint's bits into m parts and give part i a tolerance t_i so that the t_i + 1 add up to d + 1: two fingerprints
# that differ in more than t_i bits of every part differ in over d bits. So each pair within d bits is found by looking up, for
# some part, the values within its tolerance. That holds for any pair and any number of parts; m decides on cost only.

Part = tuple[int, int, int]  # first bit, bits, tolerance
_WIDEST = 22  # bits of a part that are looked up; a tolerance holds for fewer of its bits as well


@lru_cache
def _flips(bits: int, tolerance: int) -> np.ndarray:
    """All masks of so many bits with no more than ``tolerance`` of them set."""
    masks = [sum(1 << b for b in on) for k in range(min(bits, tolerance) + 1) for on in combinations(range(bits), k)]
    return np.array(masks, np.int64)


def _parts(limit: int, count: int) -> list[Part]:
    most, more = divmod(limit + 1, count)
    ends = [BITS * i // count for i in range(count + 1)]
    widest = sorted(range(count), key=lambda i: ends[i] - ends[i + 1])
    spare = set(widest[:more])
    return [(ends[i], min(ends[i + 1] - ends[i], _WIDEST), most - (i not in spare)) for i in range(count)]


@lru_cache
def parts_for(limit: int, x: int, y: int) -> list[Part]:
    """The parts by which so many rows are looked up among so many others at least cost; one of no bits, so that all pairs are compared, where that is least."""
    best, least = [(0, 0, 0)], 8.0 * x * y
    for count in range(1, min(limit + 1, BITS) + 1):
        found, cost = _parts(limit, count), 0.0
        for _, bits, tolerance in found:
            flips = sum(math.comb(bits, k) for k in range(min(bits, tolerance) + 1))
            cost += 6.0 * flips * y + 24.0 * flips * x * y / 2**bits + 4.0 * 2**bits + 20_000.0 * flips + 200.0 * (x + y)
        if cost < least:
            best, least = found, cost
    return best


def _value(words: np.ndarray, part: Part) -> np.ndarray:
    """The bits of a part of fingerprints (4, n)."""
    at, shift = divmod(part[0], 64)
    value = words[at] >> np.uint64(shift)
    if shift + part[1] > 64:
        value = value | words[at + 1] << np.uint64(64 - shift)
    return (value & np.uint64((1 << part[1]) - 1)).astype(np.int64)


def _near(x: np.ndarray, y: np.ndarray, limit: int, parts: list[Part], rows: int = 1 << 15, budget: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with x[:, i] and y[:, j] of (4, n) fingerprints within ``limit`` bits, each once."""
    for p, part in enumerate(parts):
        kx, ky = _value(x, part), _value(y, part)
        by_x, by_y = np.argsort(kx, kind="stable"), np.argsort(ky, kind="stable")
        start = np.zeros((1 << part[1]) + 1, np.int32)
        np.cumsum(np.bincount(kx, minlength=1 << part[1]), out=start[1:])
        for k in range(0, len(ky), rows):
            own = by_y[k : k + rows]
            values = ky[own]
            for flip in _flips(part[1], part[2]):
                at = values ^ flip
                first = start[at]
                many = start[at + 1] - first
                hit = np.flatnonzero(many)
                if not len(hit):
                    continue
                total = np.concatenate([[0], np.cumsum(many[hit], dtype=np.int64)])
                done = 0
                while done < len(hit):
                    stop = max(done + 1, int(np.searchsorted(total, total[done] + budget, "right")) - 1)
                    some, n = hit[done:stop], many[hit[done:stop]]
                    i = by_x[np.repeat(first[some] - (total[done:stop] - total[done]), n) + np.arange(total[stop] - total[done])]
                    j = np.repeat(own[some], n)
                    done = stop
                    far = np.zeros(len(i), np.uint16)
                    for word in range(WORDS64):
                        far = far + np.bitwise_count(x[word][i] ^ y[word][j])
                        if word in (1, WORDS64 - 1):
                            near = far <= limit
                            i, j, far = i[near], j[near], far[near]
                    if not len(i):
                        continue
                    new = np.ones(len(i), bool)
                    for q in range(p):
                        new &= np.bitwise_count(_value(x[:, i], parts[q]) ^ _value(y[:, j], parts[q])) > parts[q][2]
                    yield i[new], j[new]


def _links_of_blocks(half: np.ndarray, ids: np.ndarray, fp: list[np.ndarray], limit: int, hold: int = 1 << 18) -> list[np.ndarray]:
    """(a, b, n) as ``_links_in_cells`` gives them, of the pairs of one block (half 0) or between two (1 and 2)."""
    words = np.stack([f.view(np.uint64) for f in fp])
    n = len(ids)
    at_x, at_y = (np.flatnonzero(half <= 1), np.flatnonzero((half == 0) | (half == 2)))
    label, count = np.arange(n), np.zeros(n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take() -> None:
        a, b = (np.concatenate(c) for c in zip(*found))
        joined(label, a, b)
        np.add.at(count, a, 1)
        np.add.at(count, b, 1)
        found.clear()

    if len(at_x) and len(at_y):
        held = 0
        for i, j in _near(words[:, at_x], words[:, at_y], limit, parts_for(limit, len(at_x), len(at_y))):
            a, b = at_x[i], at_y[j]
            once = (half[a] > 0) | (a < b)
            found.append((a[once], b[once]))
            held += len(a)
            if held > hold:
                take()
                held = 0
        if found:
            take()
    some = np.flatnonzero((label != np.arange(n)) | (count > 0))
    return [ids[some], ids[label[some]], count[some]]


def all_links(unique: DataFrame, max_distance: int, rows: int, block_rows: int = 1 << 20, least_blocks: int = 8) -> DataFrame:
    """(a, b, n) as ``near_links`` gives them, of every pair of rows (doc_id, f0..f3) of different fingerprints within ``max_distance``.

    Rows are spread over blocks by their fingerprint; each pair of blocks is a task's cell, in which the parts of ``parts_for`` find
    all pairs. A row is sent once for each block, 48 bytes; blocks become more where they would hold over ``block_rows`` of ``rows``.
    """
    blocks = max(least_blocks, -(-rows // block_rows))
    own = F.pmod(F.xxhash64(*_FP), F.lit(blocks)).cast("int")
    placed = unique.select("doc_id", *_FP, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    half = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2).cast("byte")
    cells = placed.select((F.least("own", "with") * blocks + F.greatest("own", "with")).alias("cell"), half.alias("half"), "doc_id", *_FP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches):
            cell, *cols = (batch.column(i).to_numpy() for i in range(batch.num_columns))
            ends = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]
            for i, j in zip(ends, ends[1:]):
                half, ids, *fp = (c[i:j] for c in cols)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _links_of_blocks(half, ids, fp, max_distance))], ["a", "b", "n"])

    return cells.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, n long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_distance: int, grid_count: int | None, grid_segments: int | None, cell_rows: int = 1 << 14) -> DataFrame:
    """(doc_id, t, group_id, n_links) of every text with a fingerprint."""
    prints = cut(fingerprint_table(docs, id_col, text_col))
    same = cut(prints.groupBy(*_FP).agg(F.min("doc_id").alias("node")))
    unique = same.withColumnRenamed("node", "doc_id")
    if grid_count or grid_segments:
        grid_segments = grid_segments or segments_for(prints.count())
        grid_count = grid_count or grids_for(grid_segments, max_distance)
        links = cut(near_links(unique, max_distance, grid_count, grid_segments, cell_rows))
    else:
        links = cut(all_links(unique, max_distance, unique.count()))
    groups = connected_components(links.select("a", "b")).withColumnRenamed("component", "group_id")
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").cast("int").alias("n_links"))
    named = same.join(groups, "node", "left").join(counts, "node", "left")
    named = named.select(*_FP, F.coalesce("group_id", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints.join(named, _FP).select("doc_id", "t", "group_id", "n_links")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 32, grid_count: int | None = None, grid_segments: int | None = None) -> DataFrame:
    """Groups of exact and near copies: (doc_id, group_id, kept, n_links), for documents in groups of two or more.

    Two texts are near when the 256-bit SimHashes of their word sets differ in at most ``max_distance`` bits; groups are
    the connected components of that relation, named by their least doc_id, and that document is the one ``kept``. ``n_links``
    counts the different fingerprints that a document's is near to. Word sets ignore ASCII case, order, repetition and
    punctuation; texts without any word match exact copies only.

    Copies with one fingerprint are merged before the join, however many they are. The join is exact: every pair of different
    fingerprints within ``max_distance`` is found (``all_links``). Only where ``grid_count`` or ``grid_segments`` are given, a sampled
    join takes its place: a pair is compared where all segments of one of the grids agree, so some pairs are missed (``grids_for``).

    Empty or null texts and rows without id are in no group. Rows that repeat a doc_id with the same text are one document; with
    different texts an id has a row for each group that one of them is in. Other columns are ignored; an empty table gives no rows.
    """
    every = cut(_grouped(docs, id_col, text_col, max_distance, grid_count, grid_segments).groupBy("doc_id", "group_id").agg(F.max("n_links").alias("n_links")))
    shared = every.where("doc_id <> group_id").select("group_id").distinct()
    return every.join(shared, "group_id").select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"), "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 32, grid_count: int | None = None, grid_segments: int | None = None) -> DataFrame:
    """The rows of docs, one document of each group of ``near_duplicate_groups``: the rows of its least id. Rows in no group stay, nulls and empty texts too.

    A row goes by its id and its text: of rows that repeat an id with different texts only those go whose text another document
    has. Otherwise rows that repeat an id stay as many as they were, unless they repeat whole rows: of these one stays.
    """
    found = _grouped(docs, id_col, text_col, max_distance, grid_count, grid_segments)
    gone = cut(found.where("doc_id <> group_id").select(F.col("doc_id").alias("__gone"), F.col("t").alias("__text")).distinct())
    rest = docs.join(gone, (docs[id_col].cast("long") == gone["__gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__text"]), "left_anti")
    again = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"))
    if again.isEmpty():
        return rest
    repeats = rest.join(again, rest[id_col] == again["__again"], "left_semi").dropDuplicates()
    return rest.join(again, rest[id_col] == again["__again"], "left_anti").unionByName(repeats)
