"""Token ids as raw payloads, found by document key through minimal perfect hash indexes."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encode_column, encoder, ship
from .lineage import cut, qualified, shared_folder
from .textblocks import mix64

GAMMA = 2  # bits of a level for each key that it gets
_MOST_LEVELS = 64
_BUCKET_SALT, _PRINT_SALT = 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179


def key_hash(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix64(mix64(keys.astype(np.int64).view(np.uint64) ^ np.uint64(salt)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The index bucket of each key."""
    return (key_hash(keys, _BUCKET_SALT) % np.uint64(buckets)).astype(np.int64)


def print_of(keys: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprint that tells a key from one that was never stored, but for 1 in 2**32."""
    return (key_hash(keys, _PRINT_SALT) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct integer keys: slot() is one to one from the keys onto 0..n-1.

    Level by level, keys that alone hash to a bit set it and are done; the rest go on. A key's slot is the rank of its bit. With
    GAMMA 2, six keys in ten are done at each level, so a lookup takes 1.6 levels on average, whatever n is.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (key_hash(keys, 0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, rest = [], [], keys
        while len(rest):
            if len(sizes) == _MOST_LEVELS:
                raise ValueError("keys repeat")
            size = max(64, -(-GAMMA * len(rest) // 64) * 64)
            at = cls._position(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; of a key never stored any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = self.base[level] + self._position(keys[left], level, int(size))
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word] & ((np.uint64(1) << shift) - np.uint64(1)))
            out[left[hit]] = (self.rank[word] + below)[hit]
            left = left[~hit]
        return out


def _files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, data: bytes) -> None:
    """The file appears whole or not at all; attempts that write the same file agree."""
    fs, path = _files(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def pack_index(keys: np.ndarray, shard: np.ndarray, files: list[str], offset: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
    """An index file of distinct keys, and the keys' slots: the hash, then by slot fingerprint, shard, offset and count of ids."""
    mph = PerfectHash.build(keys)
    slot = mph.slot(keys)
    out = io.BytesIO()
    for a in (mph.sizes, mph.words, *(_placed(x, slot) for x in (print_of(keys), shard.astype(np.int32), offset.astype(np.int64), count.astype(np.int32))), np.frombuffer(json.dumps(files).encode(), np.uint8)):
        np.save(out, a, allow_pickle=False)
    return out.getvalue(), slot


def _placed(x: np.ndarray, slot: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[slot] = x
    return out


def write_token_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keys_per_index: int = 100_000) -> DataFrame:
    """Stores every document's token ids below ``folder`` and returns (doc_id, index, slot, fingerprint, shard, id_offset, n_ids) by key.

    Each task appends its rows' ids, little-endian and of 16 or 32 bits as the vocabulary needs, to one file of ``shards``, named
    by task and attempt: attempts never share a file, and the ``manifest`` tells whose counts. The text isn't shuffled; (key,
    place) pairs are, into index files of about ``keys_per_index`` keys. ``folder`` must be new and shared by all executors.

    Keys are integers. Rows without key or text aren't stored; an empty text has 0 ids. Of rows that repeat a key all are stored
    and the first, by shard and offset, is indexed. Other columns are ignored. An empty table makes a store that finds nothing.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    shipped = ship(spark, vocabulary)
    wide = encoder(shipped.value).size > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, name = task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, path = _files(f"{folder}/shards/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path)
            for i, j, ids, at, *_ in encode_column(batch.column(1), shipped.value):
                out.write(ids.astype(kind).tobytes())
                n = j - i
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.full(n, number, np.int32)), pa.array([name] * n), pa.array(at[:-1] + done), pa.array(np.diff(at).astype(np.int32))], ["doc_id", "shard", "file", "id_offset", "n_ids"])
                done += int(at[-1])
        if out is not None:
            out.close()

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    thin.mapInArrow(store, "doc_id long, shard int, file string, id_offset long, n_ids int").write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema("doc_id long, shard int, file string, id_offset long, n_ids int").parquet(f"{folder}/manifest")
    # the first place of each key, before keys are brought together: a key may be repeated by any number of rows
    manifest = cut(manifest.groupBy("doc_id").agg(F.min(F.struct("shard", "id_offset", "file", "n_ids")).alias("x")).select("doc_id", "x.shard", "x.file", "x.id_offset", "x.n_ids"))
    indexes = max(1, -(-manifest.count() // keys_per_index))
    _write(f"{folder}/store.json", json.dumps({"indexes": indexes, "bytes": kind.itemsize}).encode())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bucket_of(batch.column(0).to_numpy(), indexes)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["index", *batch.schema.names])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        keys, index = table["doc_id"].to_numpy(), table["index"][0].as_py()
        named = table["file"].combine_chunks().dictionary_encode()
        data, slot = pack_index(keys, named.indices.to_numpy(), named.dictionary.to_pylist(), table["id_offset"].to_numpy(), table["n_ids"].to_numpy())
        _write(f"{folder}/index/{index:06d}", data)
        return pa.table({"doc_id": keys, "index": table["index"], "slot": slot.astype(np.int32), "fingerprint": print_of(keys).astype(np.int64), "shard": table["shard"], "id_offset": table["id_offset"], "n_ids": table["n_ids"]})

    placed = manifest.mapInArrow(place, "index int, doc_id long, shard int, file string, id_offset long, n_ids int")
    return placed.groupBy("index").applyInArrow(build, "doc_id long, index int, slot int, fingerprint long, shard int, id_offset long, n_ids int")


def token_store(docs: DataFrame, folder: str | None = None, **how: object) -> DataFrame:
    """``write_token_store`` into a new folder, of the shared folder where none is named; its rows, with the indexes written."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    written = f"{folder}/entries"
    write_token_store(docs, folder, **how).write.parquet(written)
    return docs.sparkSession.read.schema("doc_id long, index int, slot int, fingerprint long, shard int, id_offset long, n_ids int").parquet(written)


class TokenStore:
    """Reads a store: get(key) takes one hash evaluation, one index entry and one ranged read of a shard.

    ``most_loaded`` indexes are kept in memory. A folder without scheme lies in the local file system.
    """

    def __init__(self, folder: str, most_loaded: int = 8):
        self.folder, self.most_loaded = folder, most_loaded
        with self._open("store.json") as f:
            about = json.loads(f.read())
        self.indexes, self.kind = about["indexes"], np.dtype("<u4" if about["bytes"] == 4 else "<u2")
        self._loaded: dict[int, tuple | None] = {}

    def _open(self, name: str):
        fs, path = _files(f"{self.folder}/{name}")
        return fs.open_input_file(path)

    def _index(self, i: int) -> tuple | None:
        if i not in self._loaded:
            try:
                with self._open(f"index/{i:06d}") as f:
                    raw = io.BytesIO(f.read())
            except FileNotFoundError:
                found = None
            else:
                a = [np.load(raw, allow_pickle=False) for _ in range(7)]
                found = (PerfectHash(a[0], a[1]), *a[2:6], json.loads(a[6].tobytes()))
            while len(self._loaded) >= self.most_loaded:
                self._loaded.pop(next(iter(self._loaded)))
            self._loaded[i] = found
        return self._loaded[i]

    def get(self, key: int) -> np.ndarray | None:
        """The key's token ids; None for a key that isn't stored."""
        return self.get_many([key])[0]

    def get_many(self, keys: Iterable[int | None]) -> list[np.ndarray | None]:
        """Token ids of each key, in the order of keys; index by index, and in each by shard and offset."""
        asked = list(keys)
        out: list[np.ndarray | None] = [None] * len(asked)
        given = np.array([n for n, k in enumerate(asked) if k is not None], np.int64)
        if not len(given):
            return out
        k = np.array([asked[n] for n in given], np.int64)
        bucket = bucket_of(k, self.indexes)
        for b in np.unique(bucket):
            found = self._index(int(b))
            if found is None:
                continue
            mph, prints, shard, offset, count, files = found
            here = np.flatnonzero(bucket == b)
            slot = mph.slot(k[here])
            known = slot >= 0
            known[known] = prints[slot[known]] == print_of(k[here][known])
            here, slot = here[known], slot[known]
            order = np.lexsort((offset[slot], shard[slot]))
            here, slot = here[order], slot[order]
            for s in np.unique(shard[slot]):
                with self._open(f"shards/{files[s]}") as f:
                    for n, x in zip(here[shard[slot] == s], slot[shard[slot] == s]):
                        f.seek(int(offset[x]) * self.kind.itemsize)
                        out[given[n]] = np.frombuffer(f.read(int(count[x]) * self.kind.itemsize), self.kind)
        return out


def read_token_store(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids) for each row of keys, null ids for null keys and keys that aren't stored: a distributed keyed read.

    Keys are brought together by index, so that a task loads each of its indexes once and holds one; an index that very many rows
    ask for is split over tasks by adaptive execution. Repeated keys are answered each time; other columns are ignored.
    """
    folder = qualified(spark, folder)
    indexes = TokenStore(folder).indexes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bucket_of(batch.column(0).fill_null(0).to_numpy(), indexes)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0)], ["index", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = TokenStore(folder, most_loaded=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.column(1).slice(i, 1000)
                ids = store.get_many(part.to_pylist())
                yield pa.RecordBatch.from_arrays([part, pa.array([None if x is None else x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    thin = keys.select(F.col(key_col).cast("long").alias("doc_id")).mapInArrow(place, "index int, doc_id long")
    return thin.hint("rebalance", "index").sortWithinPartitions("index").mapInArrow(run, "doc_id long, token_ids array<int>")
