"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .textblocks import blocks, prefix_hash, runs, segment_sum, span_hash, string_buffers, words

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "stops", "symbols", "capitals", "blanks",
    "line_bytes", "repeated_lines", "distinct_words", "short_words", "commonest_word", "symbol_words",
)
#: The score may only fall as these grow (-1), or rise (1).
MONOTONIC = {"symbols": -1, "repeated_lines": -1, "symbol_words": -1, "commonest_word": -1}

_CLASS = np.full(256, 5, np.uint8)  # 0 letter, 1 capital, 2 digit, 3 stop, 4 blank, 5 symbol
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of rows of UTF-8 bytes; all zero for empty rows."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    share = np.bincount(row * 6 + kind, minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
    hashes, start, at = words(data, offsets)
    count = np.diff(at).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(at))
    ends = runs(_CLASS[data] != 4, offsets)  # what blanks part
    token_row = np.searchsorted(offsets, ends[0], "right") - 1
    odd = np.concatenate([[0], np.cumsum(kind == 5)])
    tokens = np.maximum(np.bincount(token_row, minlength=n), 1)
    symbol_words = np.bincount(token_row, weights=(odd[ends[1]] - odd[ends[0]]) > 0, minlength=n) / tokens
    letters = segment_sum((kind <= 2).astype(np.int64), offsets)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], times)
    distinct = np.bincount(o[first], minlength=n)
    word_size = np.zeros(0)
    if len(start):
        word_end = runs(_CLASS[data] < 3, offsets)
        word_size = (word_end[1] - word_end[0]).astype(np.float64)
        short = np.bincount(np.searchsorted(offsets, word_end[0], "right") - 1, weights=word_size <= 3, minlength=n)
    else:
        short = np.zeros(n)
    line_start, line_end = runs(data != 10, offsets)
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_hash = span_hash(prefix_hash(data), line_start, line_end)
    order = np.lexsort((line_hash, line_row))
    lh, lr = line_hash[order], line_row[order]
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    repeated = np.bincount(lr, weights=again * (line_end - line_start)[order], minlength=n) / np.maximum(size, 1)
    some = np.maximum(count, 1)
    cols = (np.log1p(size), np.log1p(count), letters / some, share[:, 0] + share[:, 1], share[:, 2], share[:, 3], share[:, 5], share[:, 1], share[:, 4], np.log1p(size / lines), repeated, distinct / some, short / some, most / some, symbol_words)
    return np.where(size[:, None] > 0, np.stack(cols, 1), 0.0)


@dataclass(frozen=True)
class TreeModel:
    """Perfect binary trees laid out level by level: node k's children are 2k + 1 and 2k + 2, and the last level holds values."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of all trees for each row, all trees descending together."""
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        tree = np.arange(trees)[None, :]
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            node = np.zeros((len(part), trees), np.int64)
            rows = np.arange(len(part))[:, None]
            while trees and node[0, 0] < inner:
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.threshold[tree, node])
            if trees:
                total[i : i + 4096] += self.value[tree, node - inner].sum(1)
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train_trees(x: np.ndarray, y: np.ndarray, monotonic: Mapping[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> TreeModel:
    """Newton boosting of logistic loss on binned features.

    A constrained feature is split only if the children's values follow its direction, and their midpoint then bounds all that
    grows below them, so that each tree, and the sum, is monotonic in it. Ties go to the first feature and the least threshold.
    """
    monotonic = monotonic or {}
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(p / (1 - p)))
    inner = (1 << depth) - 1
    empty = TreeModel(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # code <= k is x <= cuts[k]
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            first = (1 << level) - 1
            width = 1 << level
            best = np.full(width, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * (len(c) + 1) + code[:, f]
                gs = np.bincount(key, weights=g, minlength=width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(key, weights=h, minlength=width * (len(c) + 1)).reshape(width, -1)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gr, hr = gt - gl, ht - hl
                at = np.arange(first, first + width)
                left = np.clip(-gl / (hl + ridge), low[at, None], high[at, None])
                right = np.clip(-gr / (hr + ridge), low[at, None], high[at, None])

                def loss(gsum: np.ndarray, hsum: np.ndarray, v: np.ndarray) -> np.ndarray:
                    return gsum * v + 0.5 * (hsum + ridge) * v * v

                own = np.clip(-gt / (ht + ridge), low[at, None], high[at, None])
                gain = loss(gt, ht, own) - loss(gl, hl, left) - loss(gr, hr, right)
                gain[(hl < least) | (hr < least)] = 0
                sign = monotonic.get(f, 0)
                if sign:
                    gain[sign * (right - left) < 0] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w], me = top[w], first + w
                    feature[me], threshold[me] = f, c[k[w]]
                    for child in (2 * me + 1, 2 * me + 2):
                        low[child], high[child] = low[me], high[me]
                    if sign:
                        mid = (left[w, k[w]] + right[w, k[w]]) / 2
                        up, down = (2 * me + 2, 2 * me + 1) if sign > 0 else (2 * me + 1, 2 * me + 2)
                        low[up], high[down] = max(low[me], mid), min(high[me], mid)
            unsplit = np.flatnonzero(best <= 1e-9) + first
            for me in unsplit:
                low[2 * me + 1] = low[2 * me + 2] = low[me]
                high[2 * me + 1] = high[2 * me + 2] = high[me]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        value = rate * np.clip(-gs / (hs + ridge), low[inner:], high[inner:])
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return TreeModel(base, np.array(features), np.array(thresholds), np.array(values))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics array<double>) of every row; zeros for null and empty texts. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(1))
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for i, j in blocks(offsets):
                x[i:j] = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "statistics"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, statistics array<double>")


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = 20_000) -> TreeModel:
    """Trees from the labelled documents, at most ``max_train_rows`` of them: those of least hashed id.

    An id with several labels takes the least. Labels that are null or of no document don't count. Without labels of both kinds
    the model has no trees and scores every document alike.

    The chosen ids, never more than ``max_train_rows``, go to the documents: texts aren't shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"))
    chosen = cut(known.orderBy(F.xxhash64("__id"), "__id").limit(max_train_rows))
    thin = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("text"))  # docs may have columns of any name
    sample = thin.join(F.broadcast(chosen), thin["__key"] == chosen["__id"]).select(F.col("__id").alias("doc_id"), "text")
    both = document_statistics(sample).join(F.broadcast(chosen.withColumnRenamed("__id", "doc_id")), "doc_id").select("statistics", "__label").toPandas()
    if not len(both):
        return train_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(both["statistics"].tolist()), (both["__label"].to_numpy() > 0).astype(np.float64)
    order = np.lexsort((y, *x.T))  # whatever order the rows came in
    x, y = x[order], y[order]
    return train_trees(x, y, {FEATURES.index(k): v for k, v in MONOTONIC.items()})


def score_quality(docs: DataFrame, model: TreeModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for every row: the probability of good quality, and whether it reaches ``threshold``.

    Null and empty texts, and texts of blanks only, have score 0 and aren't kept. Ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(1))
            score = _score_rows(model, data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "keep"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, score double, keep boolean")


def _score_rows(model: TreeModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    score = np.zeros(len(offsets) - 1)
    for i, j in blocks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        x = statistics(part, off)
        some = segment_sum((_CLASS[part] != 4).astype(np.int64), off) > 0
        score[i:j] = np.where(some, model.score(x), 0.0)
    return score


def drop_poor_documents(docs: DataFrame, model: TreeModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, that ``score_quality`` keeps. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            data, offsets, _ = string_buffers(column.cast(pa.string()) if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type) else column)
            yield batch.filter(pa.array(_score_rows(model, data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
