"""Line dedup by a segment-partition join on edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .cells import meet_in_cells, strips
from .lineage import cut
from .textblocks import blocks, mix64, prefix_hash, runs, span_hash, string_buffers


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in its row from 0, start and end of each non-empty line; empty lines are counted too."""
    start, end = runs(data != 10, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    return row, feeds[start] - feeds[offsets[row]], start, end


def line_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, 2) longs: 128 bits of a keyed hash of each line's bytes, which stand for the line wherever lines are compared as equal."""
    raw = data.tobytes()
    out = b"".join([blake2b(raw[a:b], digest_size=16, key=b"line").digest() for a, b in zip(start.tolist(), end.tolist())])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _pointer(digest: np.ndarray) -> np.ndarray:
    """63 bits of digests by which candidates are named; the lowest bit is 0."""
    return digest[:, 0] & ~np.int64(1)


def _parities(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits by line: of how many bytes of each of 32 kinds it has an odd number. An edit turns two of them at most."""
    bit = np.uint32(1) << (mix64(data.astype(np.uint64)) >> np.uint64(59)).astype(np.uint32)
    upto = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(bit)])
    return (upto[end] ^ upto[start]).view(np.int32)


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs of other bytes than blanks in each line."""
    dark = ~np.isin(data, np.frombuffer(b" \t\r\v\f", np.uint8))
    first = dark.copy()
    first[1:] &= ~dark[:-1]
    first[start] = dark[start]
    upto = np.concatenate([[0], np.cumsum(first)])
    return upto[end] - upto[start]


def segments(size: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of tau + 1 for lines of these sizes; the longer ones come last."""
    parts = tau + 1
    least, longer = size // parts, size % parts
    extra = np.maximum(0, i - (parts - longer))
    return i * least + extra, least + (i >= parts - longer)


def _key(size: np.ndarray, i: int, content: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(content + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))


def index_keys(prefix: np.ndarray, start: np.ndarray, size: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of each of a line's tau + 1 segments, by its length and place."""
    for i in range(tau + 1):
        at, n = segments(size, i, tau)
        yield np.arange(len(start)), _key(size, i, span_hash(prefix, start + at, start + at + n))


def probe_keys(prefix: np.ndarray, start: np.ndarray, size: np.ndarray, tau: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of the substrings that could be segments of a line as long or up to tau shorter, within tau edits.

    For segment i at p, and lines d shorter, a match shifted by x must have at most i edits before it and at most tau - i
    after it: |x| <= i and |x - d| <= tau - i. The line's own segments, where neither differs, are among the index keys.
    """
    for d in range(tau + 1):
        shorter = size - d
        ok = np.flatnonzero(shorter >= least)
        for i in range(tau + 1):
            at, n = segments(shorter[ok], i, tau)
            for x in range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1):
                if d == x == 0:
                    continue
                fit = np.flatnonzero((at + x >= 0) & (at + x + n <= size[ok]))
                line = ok[fit]
                begin = start[line] + at[fit] + x
                yield line, _key(shorter[line], i, span_hash(prefix, begin, begin + n[fit]))


def banded_distance(data: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, tau: int) -> np.ndarray:
    """Edit distance in bytes of pairs of lines at a and b in data, or tau + 1 where it is more; tau <= 31.

    The dynamic programme's band of 2 tau + 1 diagonals is a machine word for each pair, moved along all pairs at once.
    """
    swap = size_a < size_b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    n, m = np.where(swap, size_b, size_a), np.where(swap, size_a, size_b)
    out = np.full(len(a), tau + 1, np.int64)
    near = np.flatnonzero((n - m <= tau) & (n > tau))
    near = near[np.argsort(n[near], kind="stable")]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    one, width = np.uint64(1), 2 * tau + 1
    full, top = np.uint64((1 << width) - 1), np.uint64(1 << (width - 1))
    for part in np.array_split(near, max(1, -(-len(near) // 8192))):
        if not len(part):
            continue
        pa_, pb, pn, pm = a[part], b[part], n[part], m[part]
        vp = np.full(len(part), ((1 << (tau + 1)) - 1) << tau, np.uint64)
        vn = np.zeros(len(part), np.uint64)
        dist = np.full(len(part), tau, np.int64)
        for i in range(int(pm.max())):
            live = np.flatnonzero(pm > i)
            if len(live) == len(part):
                live = slice(None)
            la, lb, ln, p, v = pa_[live], pb[live], pn[live], vp[live], vn[live]
            letter = padded[lb + i]
            x = np.zeros(len(la), np.uint64)
            for bit in range(width):
                k = i - tau + bit
                if k >= 0:
                    hit = (padded[np.minimum(la + k, len(data))] == letter) & (k < ln)
                    x |= hit.astype(np.uint64) << np.uint64(bit)
            d0 = ((((x & p) + p) ^ p) | x | v) & full
            hp = (v | ~(d0 | p)) & full
            hn = d0 & p
            diagonal = i < ln - tau
            mask = one << np.clip(width - 2 - (i - (ln - tau)), 0, 63).astype(np.uint64)
            step = np.where(diagonal, (d0 & top) == 0, ((hp & mask) != 0).astype(np.int64) - ((hn & mask) != 0))
            dist[live] += step
            vp[live] = (hn | ~((d0 >> one) | hp)) & full
            vn[live] = (d0 >> one) & hp
        out[part] = np.minimum(dist, tau + 1)
    return out


_LINE_SCHEMA = "doc_id long, line_no int, d1 long, d2 long, size int, words int"


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, d1, d2, size, words) of every non-empty line of every row with an id; d1 and d2 are the line's digest, size its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets, _ = string_buffers(batch.column(1))
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                row, number, start, end = _lines(part, offsets[i : j + 1] - offsets[i])
                d = line_digests(part, start, end)
                cols = (ids[i:j][row], number.astype(np.int32), d[:, 0], d[:, 1], (end - start).astype(np.int32), _words(part, start, end).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _LINE_SCHEMA.split(", ")])

    return _thin(docs, id_col, text_col).mapInArrow(run, _LINE_SCHEMA)


def _thin(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text <> ''")


def _distinct_lines(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end of each different line."""
    d = line_digests(data, start, end)
    _, first = np.unique(d.view([("a", np.int64), ("b", np.int64)]).ravel(), return_index=True)
    return d[first], start[first], end[first]


def _key_rows(docs: DataFrame, tau: int, least: int) -> DataFrame:
    """(key, h, p) of lines of ``least`` bytes or more: a segment's or, where h's lowest bit is 1, a probe's key, the line's pointer
    and parities; a line's repeats in one block of text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(1))
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                _, _, start, end = _lines(part, offsets[i : j + 1] - offsets[i])
                long = end - start >= least
                if not long.any():
                    continue
                prefix = prefix_hash(part)
                d, start, end = _distinct_lines(part, start[long], end[long])
                size, h, parity = end - start, _pointer(d), _parities(part, start, end)
                for probe, found in ((0, index_keys(prefix, start, size, tau)), (1, probe_keys(prefix, start, size, tau, least))):
                    got = list(found)
                    line, key = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h[line] | probe), pa.array(parity[line])], ["key", "h", "p"])

    return docs.mapInArrow(run, "key long, h long, p int")


def _met(cols: list[np.ndarray], half: np.ndarray, tau: int) -> list[np.ndarray]:
    """(a, b), a < b: pointers of lines of which one's segment met the other's segment or probe, whose parities tau edits could part."""
    key, h, p = cols
    order = np.lexsort((half, h, key))
    key, h, p, half = key[order], h[order], p[order], half[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (half[1:] != half[:-1])
    key, h, p, half = key[new], h[new], p[new], half[new]
    probe, h = (h & 1) == 1, h & ~1
    found = [np.zeros((0, 2), np.int64)]
    for a, b in strips(np.searchsorted(key, key, "right") - np.arange(len(key)) - 1):
        near = np.bitwise_count((p[a] ^ p[b]).view(np.uint32)) <= 2 * tau
        a, b = a[near], b[near]
        ok = ~(probe[a] & probe[b]) & (h[a] != h[b]) & ((half[a] == 0) | (half[a] != half[b]))
        a, b = h[a[ok]], h[b[ok]]
        if len(a):
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
    pair = np.unique(np.concatenate(found), axis=0)
    return [pair[:, 0], pair[:, 1]]


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 2, least_bytes: int = 20) -> DataFrame:
    """(a1, a2, b1, b2): digests of different lines, of ``least_bytes`` or more each, within ``max_edits`` edits in bytes, each pair once. Exact.

    Lines are cut into max_edits + 1 segments. Two lines so near agree in a segment, at a place that lengths and edits bound; a
    shuffle on (length, place, content) brings segments and the substrings that could match them together. Of those that meet,
    only pairs whose byte parities allow for so few edits leave the cell; their texts are fetched, through a Bloom filter, and
    compared.
    """
    if not 0 <= max_edits < least_bytes:
        raise ValueError("max_edits must be less than least_bytes")
    thin = _thin(docs, id_col, text_col)

    def compare(cols: list[np.ndarray], half: np.ndarray) -> list[np.ndarray]:
        return _met(cols, half, max_edits)

    pairs = cut(meet_in_cells(_key_rows(thin, max_edits, least_bytes), compare, ("a", "b")).distinct())
    ends = pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h")))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.build(ends, 2 * pairs.count()))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(1))
            for i, j in blocks(offsets):
                part = data[offsets[i] : offsets[j]]
                _, _, start, end = _lines(part, offsets[i : j + 1] - offsets[i])
                long = end - start >= least_bytes
                d, start, end = _distinct_lines(part, start[long], end[long])
                keep = bloom.may_hold(wanted.value, _pointer(d))
                lines = pa.array([part[a:b].tobytes() for a, b in zip(start[keep], end[keep])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_pointer(d[keep])), pa.array(d[keep, 0]), pa.array(d[keep, 1]), lines], ["h", "d1", "d2", "line"])

    found = cut(thin.mapInArrow(texts, "h long, d1 long, d2 long, line binary").dropDuplicates(["d1", "d2"]))

    def side(name: str) -> DataFrame:
        return found.select(F.col("h").alias(name), F.col("d1").alias(f"{name}1"), F.col("d2").alias(f"{name}2"), F.col("line").alias(f"{name}_line"))

    names = ["a1", "a2", "b1", "b2"]
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a_line", "b_line", *names)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dx, ox, _ = string_buffers(batch.column(0))
            dy, oy, _ = string_buffers(batch.column(1))
            keep = pa.array(banded_distance(np.concatenate([dx, dy]), ox[:-1], np.diff(ox), oy[:-1] + len(dx), np.diff(oy), max_edits) <= max_edits)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2, 6)], names)

    return both.mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long")


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = 2,
    least_bytes: int = 20,
    max_repeats: int = 6,
    long_words: int = 50,
    copies: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, line_no, d1, d2, first_doc_id, first_line_no, n_lines, removed) for every line that has a copy, exact or near.

    Lines end at line feeds and are compared byte by byte; near means at most ``max_edits`` edits between lines of
    ``least_bytes`` or more, and shorter lines match equal ones only. A line's copies are the lines near it, itself included:
    ``n_lines`` counts them, and the first is the one of least (doc_id, line_no). ``removed`` are, except for that first one,

    * lines of ``long_words`` words or more, and shorter ones with more than ``max_repeats`` copies: a passage that comes a second
      time goes, while a heading may come a few times by chance;
    * lines that follow, in the same document, one with the same first copy.

    ``copies`` (doc_id, group_id), if given, says which documents are copies of others of their group and go as a whole later:
    the first of a line's copies is then the first in another document, if there is one, and a copy keeps lines whose first
    stands in its own group, so that it stays alike to the document that it copies.

    Empty lines, null or empty texts and rows without id have no part in it. Rows that repeat an id with the same text count
    once. Other columns are ignored; an empty table gives no rows.
    """
    digest = ["d1", "d2"]
    lines = line_table(docs, id_col, text_col).distinct()
    if copies is None:
        lines = lines.withColumn("copy", F.lit(False)).withColumn("own", F.col("doc_id"))
    else:
        group = copies.select("doc_id", F.col("group_id").alias("own"), F.lit(True).alias("copy"))
        lines = lines.join(group, "doc_id", "left").withColumn("copy", F.coalesce("copy", F.lit(False))).withColumn("own", F.coalesce("own", "doc_id"))
    lines = cut(lines)
    pairs = cut(near_lines(docs, id_col, text_col, max_edits, least_bytes))
    each = cut(lines.groupBy(*digest).agg(F.count("*").alias("n"), F.min(F.struct("copy", "doc_id", "line_no", "own")).alias("first")))
    ways = pairs.unionAll(pairs.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    near = ways.join(each, (F.col("b1") == F.col("d1")) & (F.col("b2") == F.col("d2"))).groupBy("a1", "a2").agg(F.sum("n").alias("n2"), F.min("first").alias("first2"))
    groups = each.join(near, (F.col("d1") == F.col("a1")) & (F.col("d2") == F.col("a2")), "left").where("n > 1 OR n2 IS NOT NULL").select(*digest, (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n_lines"), F.least("first", F.coalesce("first2", "first")).alias("first"))
    marked = lines.join(groups, digest)
    # the first of its document among lines with the same first copy
    inner = F.col("line_no") > F.min("line_no").over(Window.partitionBy("doc_id", "first"))
    itself = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    often = (F.col("n_lines") > max_repeats) | (F.col("words") >= long_words)
    kin = F.col("copy") & (F.col("first.own") == F.col("own"))
    return marked.select("doc_id", "line_no", *digest, F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), "n_lines", (inner | (~itself & often & ~kin)).alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **how: object) -> DataFrame:
    """docs without the lines that ``repeated_lines`` removes; every row stays. Empty lines stay, other texts stay as they are.

    ``length_col``, where docs has it, becomes the new text's characters in rows that changed. Columns keep their names,
    whatever these are.
    """
    gone = repeated_lines(docs, id_col, text_col, **how).where("removed").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("line_no", "d1", "d2")).alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    names, resize = docs.columns, bool(length_col) and length_col in docs.columns
    text_at, length_at = names.index(text_col), names.index(length_col) if resize else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = batch.column(0), batch.column(1)
            cols = row.flatten()
            touched = np.flatnonzero(out.is_valid().to_numpy(zero_copy_only=False) & cols[text_at].is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                pick = pa.array(touched)
                texts = []
                data, offsets, _ = string_buffers(cols[text_at].take(pick))
                for r, lost in enumerate(out.take(pick).to_pylist()):
                    part = data[offsets[r] : offsets[r + 1]]
                    _, number, start, end = _lines(part, np.array([0, len(part)]))
                    lost = {(x["line_no"], x["d1"], x["d2"]) for x in lost}
                    drop = {n for n, a, b in zip(number.tolist(), *line_digests(part, start, end).T.tolist()) if (n, a, b) in lost}
                    texts.append("\n".join(x for n, x in enumerate(part.tobytes().decode("utf-8", "replace").split("\n")) if n not in drop))
                cols[text_at] = _replaced(cols[text_at], touched, texts)
                if resize:
                    cols[length_at] = _replaced(cols[length_at], touched, [len(t) for t in texts])
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.join(gone, "id", "left").select("row", "gone").mapInArrow(rewrite, docs.schema)


def _replaced(column: pa.Array, at: np.ndarray, values: list) -> pa.Array:
    """column with these values at these places; unchanged stretches aren't copied through Python."""
    new = pa.array(values).cast(column.type)
    index = np.arange(len(column))
    index[at] = len(column) + np.arange(len(at))
    return pa.concat_arrays([column, new]).take(pa.array(index))
