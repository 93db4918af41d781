"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are lower-cased character n-grams of ORDERS lengths, 1 to 3, hashed to 2**BITS = 32768 places: n-grams that share a place
count as one feature, at every size of the data. The table of weights has so many rows, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .textblocks import blocks, segment_sum, string_buffers

BITS = 15
SIZE = 1 << BITS
ORDERS = 3
SCALE = 100.0
_ROWS = 512  # rows whose features are marked at once, 16 MB

_LOWER = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_K = [np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of rows of UTF-8 bytes, and their offsets; bytes that aren't UTF-8 become U+FFFD."""
    try:
        text = data.tobytes().decode()
        rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        parts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        text, rows = "".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(chars < 0x250, _LOWER[np.minimum(chars, 0x24F)], chars), rows.astype(np.int64)


def ngram_features(chars: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature of the n-gram that starts at each position, n-grams by row) for n = 1..ORDERS; SIZE where a row ends within it."""
    n = len(chars)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(n)  # characters from here to the row's end
    h = np.zeros(n, np.uint32)
    for order in range(1, ORDERS + 1):
        h[: n - order + 1] += (chars[order - 1 :] + np.uint32(order)) * _K[order - 1]
        h ^= h >> np.uint32(15)
        f = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int32)
        f[left < order] = SIZE
        yield f, np.maximum(0, np.diff(rows) - order + 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of non-empty texts; over all rows.

    Each task counts for itself and hands over at most SIZE counts at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(0))
            for i, j in blocks(offsets, 1 << 18):
                for k in range(i, j, _ROWS):
                    m = min(j, k + _ROWS)
                    chars, rows = code_points(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])
                    seen = np.zeros((m - k, SIZE + 1), bool)
                    of = np.repeat(np.arange(m - k), np.diff(rows))
                    for f, _ in ngram_features(chars, rows):
                        seen[of, f] = True
                    total[:SIZE] += seen[:, :SIZE].sum(0)
                    total[SIZE] += int((np.diff(rows) > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "df"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''").mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(SIZE + 1, np.int64)
    df[found["feature"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return df[:SIZE], int(df[SIZE])


def term_frequencies(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, frequencies) of each text: a feature's count over the text's n-grams, times SCALE."""
    out = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        chars, rows = code_points(raw, np.array([0, len(raw)]))
        count, total = np.zeros(SIZE + 1), 0
        for f, n in ngram_features(chars, rows):
            count += np.bincount(f, minlength=SIZE + 1)
            total += int(n[0])
        at = np.flatnonzero(count[:SIZE])
        out.append((at, SCALE * count[at] / max(total, 1)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(examples: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3, seed: int = 5) -> np.ndarray:
    """Weights (features + 1, classes) by FTRL-proximal with elastic net, per coordinate; the last row is the bias.

    A weight whose accumulated gradient stays within l1 is exactly zero. The bias has no l1.
    """
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        bound = np.where(at == SIZE, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= bound, 0.0, -(zz - np.sign(zz) * bound) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, x = np.append(examples[i][0], SIZE), np.append(examples[i][1], 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[labels[i]] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(SIZE + 1))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm; 1 without scores.

    Targets are smoothed, each class counting one example more, so that scores without a mistake don't make it vanish.
    """
    if not len(scores):
        return 1.0
    n, classes = scores.shape
    target = np.full(scores.shape, 1.0 / (n + classes))
    target[np.arange(n), labels] = (n + 1.0) / (n + classes)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(_softmax(scores / np.exp(t)), 1e-300))).sum(1).mean())

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass(frozen=True)
class LanguageModel:
    """``table`` holds idf x weight by feature and class, a zero row at SIZE; ``bias`` and ``temperature`` complete it."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def block_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by row and class, and which rows have a character."""
        chars, rows = code_points(data, offsets)
        total, count = np.zeros((len(rows) - 1, len(self.languages)), np.float64), np.zeros(len(rows) - 1, np.int64)
        for f, n in ngram_features(chars, rows):
            total += segment_sum(self.table[f], rows)
            count += n
        return SCALE * total / np.maximum(count, 1)[:, None] + self.bias, count > 0


def choose_training_keys(usable: DataFrame, most: int) -> DataFrame:
    """(l, k): of each language the keys of least hash, equally many by language and at most ``most`` in all, of usable (l, k, ..).

    Hashes below a bound that each language's count suggests are looked at, and the bound is raised where repeated keys leave too
    few: so only a few more keys than wanted are ever ranked.
    """
    rows = usable.select("l", "k", F.shiftrightunsigned(F.xxhash64("k", F.lit(3)), 1).alias("h"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return cut(usable.select("l", "k").limit(0))
    want, top = max(1, most // len(counts)), (1 << 63) - 1
    bounds = {x: min(top, int((1.5 * want + 100) / n * top)) for x, n in counts.items()}
    while True:
        table = F.create_map(*(F.lit(v) for pair in bounds.items() for v in pair))
        few = cut(rows.where(F.col("h") <= table[F.col("l")]).distinct())
        found = {r["l"]: r["count"] for r in few.groupBy("l").count().collect()}
        short = [x for x in bounds if found.get(x, 0) < want and bounds[x] < top]
        if not short:
            break
        bounds |= {x: min(top, bounds[x] * 4) for x in short}
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    return cut(few.withColumn("n", nth).where(F.col("n") <= want).select("l", "k"))


def train_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_train_rows: int = 4000, holdout: float = 0.2) -> LanguageModel:
    """A model from at most ``max_train_rows`` labelled texts, those of least hashed id, equally many by language; the inverse
    document frequencies are of all texts. A repeated id stands for its least text. A share ``holdout`` of the sample sets the temperature and isn't trained on.
    The driver gets the sample's features, not its texts.
    """
    df, texts = document_frequencies(docs, text_col)
    idf = np.log((1 + texts) / (1 + df)) + 1.0
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.xxhash64(text_col).cast("string")))
    usable = docs.where(F.col(lang_col).isNotNull() & (F.col(text_col) != "")).select(F.col(lang_col).cast("string").alias("l"), key.alias("k"), F.col(text_col).cast("string").alias("t"))
    few = choose_training_keys(usable, max_train_rows)
    sample = usable.join(F.broadcast(few), ["l", "k"]).groupBy("l", "k").agg(F.min("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = term_frequencies(batch.column(2).to_pylist())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(at) for at, _ in found])]).astype(np.int32))
            at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([a for a, _ in found]).astype(np.int16) if found else np.zeros(0, np.int16)))
            tf = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x for _, x in found]).astype(np.float32) if found else np.zeros(0, np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, tf], ["l", "k", "at", "tf"])

    rows = sample.mapInArrow(run, "l string, k string, at array<short>, tf array<float>").toArrow()
    if not rows.num_rows:
        return LanguageModel((), np.zeros((SIZE + 1, 0), np.float32), np.zeros(0), 1.0)
    rows = rows.sort_by([("l", "ascending"), ("k", "ascending")])
    names = rows["l"].to_pylist()
    languages = tuple(sorted(set(names)))
    labels = np.array([languages.index(x) for x in names])
    features = [(at.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(np.float64)) for at, tf in zip(rows["at"], rows["tf"])]
    examples = [(at, x * idf[at]) for at, x in features]
    out = np.random.default_rng(11).random(len(names)) < holdout
    inside, held = np.flatnonzero(~out), np.flatnonzero(out)
    w = train_ftrl([examples[i] for i in inside], labels[inside], len(languages))
    scores = np.array([examples[i][1] @ w[examples[i][0]] + w[SIZE] for i in held]).reshape(len(held), len(languages))
    table = np.zeros((SIZE + 1, len(languages)), np.float32)
    table[:SIZE] = w[:SIZE] * idf[:, None]
    return LanguageModel(languages, table, w[SIZE], fit_temperature(scores, labels[held]))


def identify_languages(docs: DataFrame, model: LanguageModel | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **how: object) -> DataFrame:
    """(doc_id, lang, predicted, confidence) for every row: the likeliest language of its whole text and its calibrated probability.

    Without a model one is trained on ``docs`` first. Ties go to the first language by name. Null or empty texts, and all rows where
    nothing is labelled, have null ``predicted`` and ``confidence``. Ids may be null or repeat; other columns are ignored.
    """
    m = model or train_language_model(docs, text_col, lang_col, id_col, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*m.languages, ""], object)
        for batch in batches:
            data, offsets, _ = string_buffers(batch.column(2))
            best, sure = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                for i, j in blocks(offsets, 1 << 18):
                    scores, some = m.block_scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    p = _softmax(scores / m.temperature)
                    best[i:j] = np.where(some, p.argmax(1), len(m.languages))
                    sure[i:j] = p.max(1)
            none = best == len(m.languages)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string(), mask=none), pa.array(sure, mask=none)], ["doc_id", "lang", "predicted", "confidence"])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, lang string, predicted string, confidence double")
