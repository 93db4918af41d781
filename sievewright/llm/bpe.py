"""Byte-level BPE through a sentencepiece model serialised from a rank file."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import blocks, prefix_hash, span_hash, string_buffers

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(source: str | bytes) -> dict[bytes, int]:
    """token -> rank from a file of ``base64 rank`` lines, or from its contents."""
    raw = source if isinstance(source, bytes) else Path(source).read_bytes()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def ship(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's contents, read by the driver and sent to every executor: a few MB, whatever the data."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """A printable character for each byte; none of them is white space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: bytes and text are length-delimited, floats 32 bits wide, integers varints."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks.

    Each token's bytes are mapped to characters and scored by negative rank, so the best-scored merge is the one of least
    rank; normalisation is the identity. One unknown piece, which no text can reach, follows the last rank.
    """
    size = max(ranks.values()) + 1
    pieces: list[bytes | None] = [None] * (size + 1)
    letters = byte_alphabet()
    for token, rank in ranks.items():
        pieces[rank] = _field(1, "".join(letters[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1)
    pieces[size] = _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)
    for i, p in enumerate(pieces):
        if p is None:  # a gap among the ranks
            pieces[i] = _field(1, f"<unused{i}>") + _field(2, 0.0) + _field(3, 5)
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + b"".join(_field(k, -1) for k in (41, 42, 43)) + _field(45, "<unk>")
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


# --- pre-tokens --------------------------------------------------------------------------------
#
# The split that byte-level vocabularies of this family use:
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# worked out for whole blocks from character classes.

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
    return table


def pretoken_starts(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted character positions at which pre-tokens start, over rows of code points; rows don't join."""
    n = len(chars)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[chars]
    head = np.zeros(n + 1, bool)
    head[offsets] = True  # a row starts here, or ends
    head = head[:n]
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # a run of spaces followed, in its row, by something else gives its last character to what follows
    last = space.copy()
    last[:-1] &= ~space[1:] & ~head[1:]
    last[-1] = False
    at = np.flatnonzero(last)
    start[at] = True
    blank = at[chars[at] == 32]
    start[blank + 1] = False  # the single blank leads the next pre-token
    # contractions: an apostrophe alone, at the start of a pre-token, before certain letters
    quote = np.flatnonzero((chars == 39) & start)
    if len(quote):
        nxt = np.append(chars, np.zeros(2, chars.dtype))
        end = offsets[np.searchsorted(offsets, quote, "right")]
        one, two = np.where(quote + 1 < end, nxt[quote + 1], 0), np.where(quote + 2 < end, nxt[np.minimum(quote + 2, n)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, width in ((short, 2), (long & ~short, 3)):
            q = quote[hit]
            start[q + 1] = False
            more = q + width
            more = more[more < n]
            start[more] = start[more] | (kind[more] == _LETTER)
    return np.flatnonzero(start)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+sizes[0]-1, starts[1].. and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ByteBPE:
    """Encoder and decoder over blocks of rows; pre-tokens are encoded once and remembered by hash."""

    def __init__(self, source: str | bytes = VOCABULARY, remember: int = 1_000_000):
        ranks = read_ranks(source)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.size = max(ranks.values()) + 1
        self._letters = dict(enumerate(byte_alphabet()))
        tokens = [b""] * (self.size + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        sizes = np.array([len(t) for t in tokens], np.int64)
        self._token_at, self._token_size = np.cumsum(sizes) - sizes, sizes
        self._token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._remember = remember
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._ids, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pieces(self, pretokens: list[str]) -> list[list[int]]:
        # bytes seen as Latin-1 characters, then mapped one by one
        return self.model.encode([p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters) for p in pretokens], num_threads=1)

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of rows of UTF-8 bytes, n+1 offsets into them, and which rows decode to their bytes again.

        Should two pre-tokens have one hash, the row that got the other's ids doesn't decode to its bytes, and is encoded anew
        without what was remembered.
        """
        ids, at = self._encode(data, offsets)
        same = self._decodes(ids, at, data, offsets)
        if same.all():
            return ids, at, same
        rows = [ids[a:b] for a, b in zip(at, at[1:])]
        for r in np.flatnonzero(~same):
            self._forget()
            rows[r] = self._encode(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[0]
        ids, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, at, self._decodes(ids, at, data, offsets)

    def _decodes(self, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        back, ends = self.decode_block(ids, at)
        same = np.diff(ends) == np.diff(offsets)
        if same.all():
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(offsets, wrong, "right") - 1] = False
            return same
        return np.array([bytes(back[a:b]) == bytes(data[c:d]) for a, b, c, d in zip(ends, ends[1:], offsets, offsets[1:])], bool)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8", "replace")
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(chars) == len(data):
            rows = offsets
        else:
            rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            if rows[-1] != len(chars):  # invalid UTF-8, which decoding replaced: row by row
                parts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
                text = "".join(parts)
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        start = pretoken_starts(chars, rows)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(chars))
        keys, first, inverse = np.unique(span_hash(prefix_hash(chars), start, end), return_index=True, return_inverse=True)
        if len(self._known) > self._remember:
            self._forget()
        known = self._known
        slot = np.array([known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            base = len(known)
            a, b = start[first[new]].tolist(), end[first[new]].tolist()
            found = self._pieces([text[i:j] for i, j in zip(a, b)])
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])
            self._ids = np.concatenate([self._ids, flat])
            slot[new] = base + np.arange(len(new))
            known.update(zip(keys[new].tolist(), range(base, base + len(new))))
        token, at = slot[inverse], self._at
        sizes = at[token + 1] - at[token]
        out = self._ids[_ragged(at[token], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, ends[np.searchsorted(start, rows)]

    def decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of rows of token ids, by the inverse mapping, and n+1 offsets into them."""
        sizes = self._token_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self._token_bytes[_ragged(self._token_at[ids], sizes)], ends[offsets]


@lru_cache(maxsize=2)
def encoder(source: str | bytes = VOCABULARY) -> ByteBPE:
    """One per worker and vocabulary, by its file's path or contents."""
    return ByteBPE(source)


def encode_column(column: pa.Array, source: str | bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of rows [i, j): ids, their offsets, and which rows decode to their bytes again."""
    data, offsets, _ = string_buffers(column)
    bpe = encoder(source)
    for i, j in blocks(offsets, 1 << 20):
        yield i, j, *bpe.encode_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): every row's whole text as ids of the vocabulary, one narrow pass.

    The columns ``also`` of docs come along under their names, which must not be those four.

    ``round_trip`` tells whether decoding gives back the text's bytes, which it does for any valid UTF-8. A null text has null
    ids, count and round trip; an empty one has no ids. Null and repeated doc_ids pass through, other columns are ignored, and
    an empty table gives no rows. ``vocabulary`` is a file of ``base64 rank`` lines that the driver reads and sends along.
    """
    shipped = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, j, ids, at, same in encode_column(batch.column(1), shipped.value):
                null = pa.array(~valid[i:j])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=null) if (~valid[i:j]).any() else pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                more = [batch.column(2 + k).slice(i, j - i) for k in range(len(also))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(at).astype(np.int32), mask=~valid[i:j]), pa.array(same, mask=~valid[i:j]), *more], ["doc_id", "token_ids", "n_tokens", "round_trip", *also])

    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    kind = thin.schema["doc_id"].dataType.simpleString()
    rest = "".join(f", `{c}` {thin.schema[c].dataType.simpleString()}" for c in also)
    return thin.mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens int, round_trip boolean{rest}")


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from token ids: the inverse of encode_documents. Null ids give null text, no ids the empty text.

    Ids outside the vocabulary, or null among the ids, raise; bytes that aren't UTF-8 are replaced by U+FFFD.
    """
    shipped = ship(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shipped.value)
        for batch in batches:
            texts: list[str | None] = []
            for row in batch.column(1):
                if not row.is_valid:
                    texts.append(None)
                    continue
                ids = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= bpe.size):
                    raise ValueError("token id outside the vocabulary")
                texts.append(bpe.decode_block(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    thin = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("token_ids"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, text string")
