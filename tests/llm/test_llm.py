from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import bloom, bpe, cells, chat, ctph, langid, linededup, mixing, quality, simhash, tokenstore, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keep string, h long"
WORDS = ["river", "stone", "quiet", "morning", "lamp", "garden", "seven", "walk", "paper", "light", "über", "señor", "winter", "table", "cloud"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a long text, repeated rows and ids, and columns with clashing names."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 200) for _ in range(400))
    texts = [None, "", "  \n ", "a", "?!", "same text here", "same text here", long, "x" * 50_000, "snow ☃ 漢字 é", prose(rng, 80)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), "z", None, 1) for i, t in enumerate(texts)]
    rows += [rows[10], (10, "another text of the same id", "en", "s", 1, None, "k", 2), (None, "no id", "de", "t", 5, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near_texts():
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(25)]
    rows = list(base)
    for t in base[:12]:
        w = t.split()
        for k in (0, 1, 3):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "changed"
            rows.append(" ".join(v))
    return rows


def test_simhash_against_all_pairs(spark):
    texts = near_texts()
    fp, has = simhash.fingerprints(pa.array(texts))
    assert has.all()
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if np.bitwise_count(fp[i] ^ fp[j]).sum() <= 32:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(texts))}
    sizes = {r: list(want.values()).count(r) for r in want.values()}
    want = {i: r for i, r in want.items() if sizes[r] > 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.near_duplicate_groups(docs).collect()
    got = {r["doc_id"]: r["group_id"] for r in rows}
    assert got == want and len(want) > 30
    first = {tuple(f): i for i, f in reversed(list(enumerate(fp.tolist())))}
    for r in rows:
        assert r["kept"] == (r["doc_id"] == r["group_id"])
        assert r["n_links"] == sum(0 < np.bitwise_count(fp[r["doc_id"]] ^ fp[j]).sum() <= 32 for j in first.values())
    unique = simhash.fingerprint_table(docs).dropDuplicates(["f0", "f1", "f2", "f3"]).cache()
    split = [simhash.near_links(unique, 32, 6, 2, n).groupBy("a").agg(F.sum("n").alias("n")).collect() for n in (3, 1 << 14)]
    assert sorted(map(tuple, split[0])) == sorted(map(tuple, split[1]))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in range(len(texts)) if got.get(i, i) == i}


@given(st.lists(st.integers(0, 2**64 - 1), min_size=8, max_size=8))
def test_manhattan_bounds_hamming(v):
    fp = np.array(v, np.uint64).reshape(2, 4)
    code = simhash.embed(fp)
    assert np.bitwise_count(code[0] ^ code[1]).sum() <= np.bitwise_count(fp[0] ^ fp[1]).sum()


def test_simhash_recall_at_the_limit(spark):
    rng, pairs = np.random.default_rng(3), 400
    fp = rng.integers(-(2**63), 2**63, (pairs, 4)).view(np.uint64)
    other = fp.copy()
    for r in range(pairs):
        for bit in rng.choice(256, 32, replace=False):
            other[r, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = [(i, i, *map(int, f)) for i, f in enumerate(np.concatenate([fp, other]).view(np.int64))]
    docs = spark.createDataFrame(rows, "doc_id long, t long, f0 long, f1 long, f2 long, f3 long")
    table, simhash.fingerprint_table = simhash.fingerprint_table, lambda docs, *_: docs
    try:
        got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    finally:
        simhash.fingerprint_table = table
    assert sum(got.get(i + pairs) == i for i in range(pairs)) >= 0.98 * pairs


def test_simhash_finds_every_pair_at_the_limit(spark):
    rng, pairs = np.random.default_rng(3), 1500
    fp = rng.integers(-(2**63), 2**63, (pairs, 4)).view(np.uint64)
    other = fp.copy()
    for r in range(pairs):
        for bit in rng.choice(256, 32 + r % 2, replace=False):
            other[r, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = [(i, i, *map(int, f)) for i, f in enumerate(np.concatenate([fp, other]).view(np.int64))]
    docs = spark.createDataFrame(rows, "doc_id long, t long, f0 long, f1 long, f2 long, f3 long")
    table, simhash.fingerprint_table = simhash.fingerprint_table, lambda docs, *_: docs
    try:
        got = simhash.near_duplicate_groups(docs).collect()
    finally:
        simhash.fingerprint_table = table
    assert {(r["doc_id"], r["group_id"], r["n_links"]) for r in got} == {(i + at, i, 1) for i in range(0, pairs, 2) for at in (0, pairs)}


@pytest.mark.parametrize("limit", [0, 3, 20, 32, 150, 256])
def test_parts_find_all_pairs(spark, limit):
    rng = np.random.default_rng(limit)
    centre = rng.integers(0, 2, (12, 256))
    bits = np.concatenate([c ^ (rng.random((30, 256)) < rng.random((30, 1)) * 0.15) for c in centre]).astype(np.uint8)
    fp = np.unique(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0)
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2, dtype=int)
    want = sorted((i, j) for i, j in np.argwhere(far <= limit) if i < j)
    words = np.ascontiguousarray(fp.T)
    for parts in ([(0, 0, 0)], simhash.parts_for(limit, len(fp), len(fp)), *(simhash._parts(limit, n) for n in (11, 16, 33) if limit in (20, 32) and n <= limit + 1)):
        assert sorted((i, j) for a, b in simhash._near(words, words, limit, parts, 100, 50) for i, j in zip(a, b) if i < j) == want
    unique = spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(fp.view(np.int64))], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    count, tied = Counter(), [np.arange(len(fp)), np.arange(len(fp))]
    for r in simhash.all_links(unique, limit, len(fp), 100).collect():
        count[r["a"]] += r["n"]
        tied[0] = np.where(tied[0] == tied[0][r["a"]], tied[0][r["b"]], tied[0])
    for i, j in want:
        tied[1] = np.where(tied[1] == tied[1][i], tied[1][j], tied[1])
    assert len(set(zip(*tied))) == len(set(tied[0])) == len(set(tied[1]))
    assert {a: n for a, n in count.items() if n} == {i: int(n) for i, n in enumerate((far <= limit).sum(1) - 1) if n}


def test_simhash_grids_follow_rows():
    for rows in (1, 10**6, 10**8, 10**10):
        s = simhash.segments_for(rows)
        assert s == 8 or 300 < rows * 0.375**s <= 1000
        assert 1 - (1 - np.prod((224 - np.arange(2 * s)) / (256 - np.arange(2 * s)))) ** simhash.grids_for(s, 32) >= 0.99
    assert simhash.grids_for(10, 0) == 1


def test_simhash_odd(odd, none):
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(odd).collect()}
    assert groups[5] == groups[6] == 5 and 0 not in groups and 1 not in groups
    rest = simhash.drop_near_duplicates(odd)
    assert rest.columns == odd.columns
    ids = [r["doc_id"] for r in rest.collect()]
    assert 6 not in ids and 5 in ids and ids.count(None) == 2 and ids.count(10) == 2
    assert simhash.near_duplicate_groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_clashing_names(spark):
    t = "\n".join(prose(random.Random(k), 60) for k in (3, 4))
    docs = spark.createDataFrame([(1, t), (2, t), (3, "other words here")], "doc_id long, text string")
    for c in ("__gone", "__text", "__again", "group_id", "node", "f0", "t", "d1", "row", "id", "gone", "h", "lang", "source", "first"):
        docs = docs.withColumn(c, F.lit(c))
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [1, 3]
    lined = linededup.drop_repeated_lines(docs)
    assert lined.columns == docs.columns and {r["doc_id"]: r["text"] for r in lined.collect()} == {1: t, 2: "", 3: "other words here"}
    mixed = mixing.in_mixed_order(docs)
    assert mixed.columns == docs.columns and {r["gone"] for r in mixed.collect()} == {"gone"}
    assert ctph.fingerprint_matches(docs).count() == bpe.encode_documents(docs).count() == langid.identify_languages(docs).count() == tokenstore.token_store(docs).count() == 3


def test_simhash_loses_no_text_of_a_repeated_id(spark):
    t, u = prose(random.Random(1), 40), prose(random.Random(2), 40)
    docs = spark.createDataFrame([(1, t), (2, t), (2, u), (3, u)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == sorted([(1, t), (2, u)])
    groups = {(r["doc_id"], r["group_id"]) for r in simhash.near_duplicate_groups(docs).collect()}
    assert groups == {(1, 1), (2, 1), (2, 2), (3, 2)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.floats(0.01, 10), min_size=1), st.integers(8, 200))
def test_pfair_stays_within_a_block(weights, period):
    shares = mixing.quantise(weights, period)
    order = mixing.pfair_period(shares)
    assert len(order) == period == sum(shares.values())
    for k, q in shares.items():
        had = np.cumsum([x == k for x, _ in order])
        ideal = np.arange(1, period + 1) * q / period
        assert np.abs(had - ideal).max() < 1


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(2000)], "doc_id long, source string")
    rows = mixing.mix_sources(docs, {"big": 1, "small": 1}, block_rows=4, period=64).orderBy("mix_position").collect()
    assert {r["doc_id"] for r in rows} == set(range(2000))
    blocks = {}
    for r in rows:
        blocks.setdefault(r["mix_slot"], set()).add(r["source"])
    assert all(len(b) == 1 for b in blocks.values())
    big = np.cumsum([next(iter(blocks[s])) == "big" for s in sorted(blocks)])
    assert np.abs(big - np.arange(1, len(big) + 1) / 2).max() < 1
    assert mixing.in_mixed_order(none).count() == 0
    mixed = mixing.in_mixed_order(odd)
    assert mixed.columns == odd.columns and mixed.distinct().count() == odd.distinct().count()


def mixed_by_loop(rows, block_rows, buckets, exponent=0.7):
    """(row, epoch, block, slot, position) of rows (source, hash, row), each slot given by looking at every source."""
    by = {}
    for source, h, row in rows:
        high = (h % 2**64) >> 1
        by.setdefault(source, []).append((min(buckets - 1, int(np.floor(high / 2.0**63 * buckets))), h, row))
    names = sorted(by, key=lambda s: "\x00none" if s is None else s)
    weights = {s: len(by[s]) ** exponent for s in names}
    share = {s: round(weights[s] / sum(weights.values()) * 2.0**62) for s in names}
    total, given, size = sum(share.values()), dict.fromkeys(names, 0), {s: -(-len(by[s]) // block_rows) for s in names}
    out, slot = [], 0
    while any(given[s] < size[s] for s in names):
        free = [(-(-(given[s] + 1) * total // share[s]), n, s) for n, s in enumerate(names) if given[s] * total // share[s] <= slot]
        s = min(free)[2]
        epoch, block = divmod(given[s], size[s])
        for r, x in enumerate(sorted(by[s])[block * block_rows : (block + 1) * block_rows]):
            out.append((x[2], epoch, given[s], slot, slot * block_rows + r))
        given[s], slot = given[s] + 1, slot + 1
    return out


def test_mixing_against_a_plain_loop(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, None if i % 11 == 0 else "abc"[min(2, i % 9)], f"t{i}") for i in range(700)], "doc_id long, source string, mix_turns string")
    docs = docs.withColumn("row", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("mix_slot", F.lit("old"))
    hashed = docs.drop("mix_slot").select("source", F.xxhash64(F.lit(17), *docs.drop("mix_slot").columns).alias("x"), "mix_turns").collect()
    most = max(sum(r["source"] == s for r in hashed) for s in ("a", "b", "c", None))
    for bucket_rows in (4096, 60):
        mixed = mixing.mix_sources(docs, block_rows=4, bucket_rows=bucket_rows)
        assert mixed.columns == ["doc_id", "source", "mix_turns", "row", "h", "mix_source", "mix_epoch", "mix_block", "mix_slot", "mix_position"]
        got = sorted((r["mix_position"], r["mix_turns"], r["mix_epoch"], r["mix_block"], r["mix_slot"]) for r in mixed.collect())
        want = sorted((p, row, e, b, s) for row, e, b, s, p in mixed_by_loop(hashed, 4, -(-most // bucket_rows)))
        assert got == want and len(got) > 700


def test_mixed_order_survives_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"s{i % 3 * (i % 5)}", "word " * (1 + i % 50)) for i in range(3000)], "doc_id long, source string, text string").repartition(8)
    want = [r["doc_id"] for r in mixing.mix_sources(docs).orderBy("mix_position").collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    mixing.in_mixed_order(docs).write.parquet(str(tmp_path / "mixed"))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    back = spark.read.parquet(str(tmp_path / "mixed"))
    got = bpe.encode_documents(mixing.written_order(back), also=("mix_position",)).orderBy("mix_position")
    assert back.select("_metadata.file_name").distinct().count() > 2 and [r["doc_id"] for r in got.collect()] == want
    assert mixing.written_order(docs).where("mix_position IS NOT NULL").count() == 0


def test_mixing_has_no_most_sources(spark):
    docs = spark.createDataFrame([(i, f"s{i // 2}") for i in range(10_000)] + [(10_000, None)], "doc_id long, source string")
    rows = mixing.mix_sources(docs, block_rows=1).collect()
    assert {r["doc_id"] for r in rows} == set(range(10_001))
    assert sorted(r["mix_slot"] for r in rows) == list(range(len(rows)))


def test_mixing_keeps_to_target_weights(spark):
    docs = spark.createDataFrame([(i, "hot") for i in range(20_000)] + [(20_000 + i, "rare") for i in range(2)], "doc_id long, source string")
    rows = mixing.mix_sources(docs, {"hot": 1, "rare": 1e-4}, block_rows=1, bucket_rows=3000).orderBy("mix_position").collect()
    rare = np.cumsum([r["source"] == "rare" for r in rows])
    assert np.abs(rare - np.arange(1, len(rows) + 1) * 1e-4 / 1.0001).max() < 1
    assert [r["mix_slot"] for r in rows] == list(range(len(rows))) and 20_000 <= len(rows) <= 20_004
    for r in rows:
        assert r["mix_block"] % (20_000 if r["source"] == "hot" else 2) + r["mix_epoch"] * (20_000 if r["source"] == "hot" else 2) == r["mix_block"]


def test_langid(spark, odd, none):
    rng = random.Random(3)
    vocabulary = {"en": "the house and river with many people walking through".split(), "de": "das haus und der fluss mit vielen menschen durch".split(), "es": "la casa y el río con mucha gente por las".split()}
    make = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(12))
    train = spark.createDataFrame([(i, make(x), x) for i, x in enumerate(list(vocabulary) * 60)], "doc_id long, text string, lang string")
    model = langid.train_language_model(train)
    test = spark.createDataFrame([(i, make(x), x) for i, x in enumerate(list(vocabulary) * 30)], "doc_id long, text string, lang string")
    got = langid.identify_languages(test, model).collect()
    assert np.mean([r["lang"] == r["predicted"] for r in got]) > 0.95
    assert all(1 / 3 <= r["confidence"] <= 1 for r in got)
    assert (model.table == 0).mean() > 0.9  # elastic net leaves most weights at zero
    out = {(r["doc_id"], r["predicted"] is None) for r in langid.identify_languages(odd).collect()}
    assert (0, True) in out and (1, True) in out and (3, False) in out
    assert langid.identify_languages(odd).count() == odd.count()
    assert langid.identify_languages(none).count() == 0


def ngrams_by_loop(text):
    """{feature: count} of a text, n-gram by n-gram with whole numbers."""
    chars, out = [ord(c.lower()) if ord(c) < 0x250 and len(c.lower()) == 1 else ord(c) for c in text], {}
    for order in (1, 2, 3):
        for i in range(len(chars) - order + 1):
            h = 0
            for k in range(order):
                h = (h + (chars[i + k] + k + 1) * int(langid._K[k])) % 2**32
                h ^= h >> 15
            f = (h * 0x27D4EB2F % 2**32) >> (32 - langid.BITS)
            out[f] = out.get(f, 0) + 1
    return out


def test_language_scores_against_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    texts = ["The river RUNS", "Über señor", "漢字 und mehr", "a", "xy"]
    for (at, tf), t in zip(langid.term_frequencies(texts), texts):
        count = ngrams_by_loop(t)
        assert dict(zip(at.tolist(), tf.tolist())) == pytest.approx({f: langid.SCALE * n / sum(count.values()) for f, n in count.items()})
    table = rng.normal(size=(langid.SIZE + 1, 3)).astype(np.float32)
    table[langid.SIZE] = 0
    model = langid.LanguageModel(("a", "b", "c"), table, rng.normal(size=3), 1.7)
    rows = langid.identify_languages(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string"), model).collect()
    for r in rows:
        count = ngrams_by_loop(texts[r["doc_id"]])
        z = [(langid.SCALE * sum(n * float(table[f, c]) for f, n in count.items()) / sum(count.values()) + model.bias[c]) / 1.7 for c in range(3)]
        p = np.exp(z - np.max(z)) / np.exp(z - np.max(z)).sum()
        assert r["predicted"] == "abc"[int(p.argmax())] and r["confidence"] == pytest.approx(p.max(), rel=1e-4)


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(2)
    examples = [(np.sort(rng.choice(40, 5, replace=False)), rng.uniform(0.1, 2, 5)) for _ in range(30)]
    labels = rng.integers(0, 3, 30)
    got = langid.train_ftrl(examples, labels, 3, alpha=0.3, beta=1.0, l1=0.4, l2=0.01, epochs=2, seed=4)
    z, n, order = {}, {}, np.random.default_rng(4)

    def weight(f, c):
        bound = 0.0 if f == langid.SIZE else 0.4
        x = z.get((f, c), 0.0)
        return 0.0 if abs(x) <= bound else -(x - np.sign(x) * bound) / ((1.0 + n.get((f, c), 0.0) ** 0.5) / 0.3 + 0.01)

    for _ in range(2):
        for i in order.permutation(30):
            terms = [*zip(examples[i][0].tolist(), examples[i][1].tolist()), (langid.SIZE, 1.0)]
            w = {(f, c): weight(f, c) for f, _ in terms for c in range(3)}
            scores = [sum(x * w[f, c] for f, x in terms) for c in range(3)]
            p = np.exp(np.array(scores) - max(scores))
            p /= p.sum()
            for f, x in terms:
                for c in range(3):
                    g = x * (p[c] - (labels[i] == c))
                    old = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / 0.3 * w[f, c]
                    n[f, c] = old + g * g
    for f in [*range(40), langid.SIZE]:
        for c in range(3):
            assert got[f, c] == pytest.approx(weight(f, c), abs=1e-9)
    assert (got[:40] == 0).any()


def test_training_keys_are_those_of_least_hash(spark):
    rows = [("hot", f"k{i % 900}", "t") for i in range(9000)] + [("rare", f"r{i}", "t") for i in range(30)]
    usable = spark.createDataFrame(rows, "l string, k string, t string").cache()
    hashed = usable.select("l", "k", F.shiftrightunsigned(F.xxhash64("k", F.lit(3)), 1).alias("h")).distinct().collect()
    for most in (100, 4000):
        want = {(r["l"], r["k"]) for x in ("hot", "rare") for r in sorted((r for r in hashed if r["l"] == x), key=lambda r: r["h"])[: most // 2]}
        assert {(r["l"], r["k"]) for r in langid.choose_training_keys(usable, most).collect()} == want
    assert langid.choose_training_keys(usable.limit(0), 10).count() == 0


def test_many_short_texts_take_little_memory(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5000)], "doc_id long, text string")
    df, n = langid.document_frequencies(docs)
    assert n == 5000 and sorted(df[df > 0].tolist()) == [2500, 2500]


def test_temperature_of_faultless_scores_is_finite():
    scores = np.eye(3)[[0, 1, 2] * 10] * 50.0
    t = langid.fit_temperature(scores, np.array([0, 1, 2] * 10))
    p = langid._softmax(scores / t).max(1)
    assert (p < 0.99).all()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("ABCab+", max_size=150), st.text("ABCab+", max_size=150)), min_size=1, max_size=6))
def test_common_letters(pairs):
    got = ctph.common_letters(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    assert got.tolist() == [lcs(a, b) for a, b in pairs]


def test_ctph_against_all_pairs(spark, odd, none):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctph.fingerprint_matches(docs).collect()}

    def grams(s):
        return {s[i : i + ctph.GRAM] for i in range(len(s) - ctph.GRAM + 1)}

    for i, r in got.items():
        best = (0, None)
        for j, q in got.items():
            if i == j:
                continue
            sides = [(x, y) for m, x in ((1, r["signature"]), (2, r["signature2"])) for k, y in ((1, q["signature"]), (2, q["signature2"])) if m * r["block_size"] == k * q["block_size"]]
            shared = any(grams(x) & grams(y) for x, y in sides)
            same = (r["block_size"], r["signature"], r["signature2"]) == (q["block_size"], q["signature"], q["signature2"])
            score = max([200 * lcs(x, y) // max(1, len(x) + len(y)) for x, y in sides], default=0) if shared else 0
            if same:
                score = 100
            if score >= 60 and score > best[0]:
                best = score, j
        assert r["score"] == (best[0] or None), i
    assert sum(r["match_id"] is not None for r in got.values()) >= 40
    lead = ctph.fingerprint_documents(docs).where("signature <> ''").dropDuplicates(["block_size", "signature", "signature2"]).cache()
    best = [{r["doc_id"]: r["x"] for r in ctph.best_matches(lead, cell_rows=n).groupBy("doc_id").agg(F.min(F.struct(-F.col("score"), "other")).alias("x")).collect()} for n in (2, 1 << 14)]
    assert best[0] == best[1] and len(best[0]) > 10
    two = ctph.fingerprint_matches(spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[25]), (3, texts[28])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["match_id"]) for r in two if r["doc_id"] > 1) == [(2, 1), (3, 1)] and len(two) == 4
    rows = ctph.fingerprint_matches(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["match_id"] == 6 and by[1]["signature"] == "" and 0 not in by and None not in by
    assert ctph.fingerprint_matches(none).count() == 0


def edited_texts():
    """Texts of several sizes, each with versions of it of which every so many words is another, and short ones."""
    rng = random.Random(11)
    rows = []
    for n in (3, 6, 30, 60, 120, 500):
        for _ in range(4):
            base = prose(rng, n).split()
            rows += [" ".join("new" + str(rng.randrange(99)) if every and k % every == every - 1 else w for k, w in enumerate(base)) for every in (0, 25, 12, 8, 5)]
            rows.append(" ".join(base[: 2 * n // 3]))
            rows.append(" ".join(base + base[: n // 2]))
    return rows + rows[::9] + ["a", "a b", "b a", "?"]


def test_ctph_links_are_those_of_all_pairs(spark):
    texts = edited_texts()
    docs = spark.createDataFrame([(3 * k % 1009, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ctph.fingerprint_matches(docs).collect()}
    assert len(got) == len(texts)
    key = {d: (r["block_size"], r["signature"], r["signature2"]) for d, r in got.items()}

    def score(p, q):
        if p == q:
            return 100
        sides = [(x, y) for m, x in ((1, p[1]), (2, p[2])) for k, y in ((1, q[1]), (2, q[2])) if m * p[0] == k * q[0]]
        return max([200 * lcs(x, y) // (len(x) + len(y)) for x, y in sides], default=0)

    classes = sorted(set(key.values()))
    near = {p: {q for q in classes if p != q and score(p, q) >= 60} for p in classes}
    apart = sum(not any(x[i : i + 7] in y for x in p[1:] for y in q[1:] for i in range(len(x) - 6)) for p in classes for q in near[p])
    assert apart > 20 and any(len(p[1]) < 7 for p in classes if near[p])  # links that seven letters in a row wouldn't show
    one = {p: min(d for d in key if key[d] == p) for p in classes}
    group = dict(one)
    for _ in classes:
        group = {p: min([group[p], *(group[q] for q in near[p])]) for p in classes}
    for d, r in got.items():
        best = min([(-score(key[d], key[e]), e) for e in key if e != d and score(key[d], key[e]) >= 60], default=(None, None))
        assert (r["score"], r["match_id"]) == (best[0] and -best[0], best[1]), d
        assert (r["n_links"], r["group_id"]) == (len(near[key[d]]), group[key[d]]), d
    rows = [(k, one[p], None, *p) for k, p in enumerate(classes)]
    table = spark.createDataFrame(rows, "node long, one long, second long, block_size int, signature string, signature2 string")
    for block_rows in (5, 1 << 14):
        count = Counter()
        for r in ctph.class_links(table, 60, block_rows).collect():
            count[r["node"]] += r["n"]
        assert dict(count) == {k: len(near[p]) for k, p in enumerate(classes) if near[p]}


def test_ctph_of_ids_with_several_texts(spark):
    texts = [t for t in edited_texts() if len(t) > 100]
    rng = random.Random(5)
    rows = [(rng.randrange(12), t) for t in texts for _ in range(2)] + [(20 + k, t) for k, t in enumerate(texts[::3])]
    got = ctph.fingerprint_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["doc_id"] for r in got}) < len(got)
    scores = {}
    for r in got:
        p, best = (r["block_size"], r["signature"], r["signature2"]), (0, 0)
        for q in got:
            k = (q["block_size"], q["signature"], q["signature2"])
            if (p, k) not in scores:
                sides = [(x, y) for m, x in ((1, p[1]), (2, p[2])) for n, y in ((1, k[1]), (2, k[2])) if m * p[0] == n * k[0]]
                scores[p, k] = scores[k, p] = 100 if p == k else max([200 * lcs(x, y) // (len(x) + len(y)) for x, y in sides], default=0)
            if q["doc_id"] != r["doc_id"] and scores[p, k] >= 60:
                best = min(best, (-scores[p, k], q["doc_id"]))
        assert (r["score"] or 0, r["match_id"] or 0) == (-best[0], best[1])
        assert r["n_links"] == len({k for (x, k), n in scores.items() if x == p and k != p and n >= 60}), r
    one, other = edited_texts()[84:86]  # two texts of document 1, of which document 7 has the second as well
    got = ctph.fingerprint_matches(spark.createDataFrame([(1, one), (1, other), (7, other)], "doc_id long, text string")).collect()
    signature = {r["signature"] for r in got if r["doc_id"] == 7}
    assert {(r["doc_id"], r["match_id"], r["n_links"], r["signature"] in signature) for r in got} == {(1, 7, 1, False), (1, 7, 1, True), (7, 1, 1, True)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ABCab+", min_size=1, max_size=200), min_size=2, max_size=8), st.sampled_from([1, 35, 60, 100]))
def test_ctph_bounds_lose_no_pair(signatures, least):
    side = ctph._Side(pa.array(signatures))
    got = sorted((i, j, s) for a, b, c in ctph._links([side], [side], least, True, 8) for i, j, s in zip(a.tolist(), b.tolist(), c.tolist()))
    scores = [(i, j, 200 * lcs(a, b) // (len(a) + len(b))) for i, a in enumerate(signatures) for j, b in enumerate(signatures) if i < j]
    assert got == [x for x in scores if x[2] >= least]


@st.composite
def just_near(draw):
    """Two signatures with as few letters in common as a score of 60 allows, and the others anywhere between these, or as far apart as they go."""
    both = draw(st.integers(2, 240))
    common = max(1, -(-60 * both // 200))
    apart = both - 2 * common
    every = draw(st.integers(0, 3))
    slots = [(k // 4 * 3 + every - 1) % (common + 1) for k in range(apart)] if every else draw(st.lists(st.integers(0, common), min_size=apart, max_size=apart))
    own = draw(st.lists(st.booleans(), min_size=apart, max_size=apart))
    letters = draw(st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=common, max_size=common))
    gaps = [Counter(k for k, first in zip(slots, own) if first == side) for side in (True, False)]
    return ["".join(out * g[k] + letters[k : k + 1] for k in range(common + 1)) for out, g in zip("ab", gaps)]


@settings(max_examples=12, deadline=None)
@given(st.lists(just_near(), min_size=2, max_size=10), st.lists(st.text("ABCab+", min_size=1, max_size=130), max_size=4), st.sampled_from([1, 3, 1 << 10]), st.sampled_from([9, 1 << 18]), st.sampled_from([8, 1e-9]))
def test_ctph_keys_lose_no_pair(pairs, more, crowd, block, most):
    one = [s for p in pairs for s in p] + more
    two = [s[::2] for s in one]
    x, y = ctph._Side(pa.array(one)), ctph._Side(pa.array(two))
    with pytest.MonkeyPatch.context() as m:
        for name, value in (("_KEYS_PAY", 0), ("_CROWD", crowd), ("_BLOCK", block), ("_MOST_MET", most)):
            m.setattr(ctph, name, value)
        same, other = (sorted(t for found in links for t in zip(*(c.tolist() for c in found))) for links in (ctph._links([x, y], [x, y], 60, True, 8), ctph._links([x], [y], 60, False, 8)))

    def score(a, b):
        return 200 * lcs(a, b) // max(1, len(a) + len(b))

    best = [(i, j, max(score(one[i], one[j]), score(two[i], two[j]))) for i in range(len(one)) for j in range(i + 1, len(one))]
    assert same == [b for b in best if b[2] >= 60]
    best = [(i, j, score(a, b)) for i, a in enumerate(one) for j, b in enumerate(two)]
    assert other == [b for b in best if b[2] >= 60]


def test_ctph_few_pairs_of_a_large_cell_are_looked_at(monkeypatch):
    rng = random.Random(9)
    letters = ctph._LETTERS.tobytes().decode()
    signatures = ["".join(rng.choices(letters, k=rng.randrange(32, 64))) for _ in range(20_000)]
    planted = {}
    for k in range(0, 20_000, 500):  # so many letters are others that no four in a row stay
        signatures[k + 1] = "".join(rng.choice(letters) if at % 4 == 3 else c for at, c in enumerate(signatures[k]))
        planted[k, k + 1] = 200 * lcs(signatures[k], signatures[k + 1]) // (2 * len(signatures[k]))
    looked = []
    within, met = ctph._within_reach, getattr(ctph, "_met", None)

    def each(x, y, *more):
        looked.append(len(x.size) * len(y.size))
        return within(x, y, *more)

    def one_by_one(*args):
        for found in met(*args):
            looked.append(len(found[0]))
            yield found

    monkeypatch.setattr(ctph, "_within_reach", each)
    if met:
        monkeypatch.setattr(ctph, "_met", one_by_one)
    side = ctph._Side(pa.array(signatures))
    got = {(i, j): s for a, b, c in ctph._links([side], [side], 60, True) for i, j, s in zip(a.tolist(), b.tolist(), c.tolist())}
    assert got == {k: s for k, s in planted.items() if s >= 60} and len(got) > 35
    assert sum(looked) < 20_000**2 // 50


def test_quality(spark, odd, none):
    rng = random.Random(5)
    good = [prose(rng, 60) + "." for _ in range(120)]
    bad = [" ".join(rng.choice(["$$$", "###", "buy", "!!"]) for _ in range(60)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 240, 2)], "doc_id long, quality int")
    model = quality.train_quality_model(docs, labels)
    got = {r["doc_id"]: r["keep"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([got[i] == (i < 120) for i in range(1, 240, 2)]) > 0.97
    scored = {r["doc_id"]: r for r in quality.score_quality(odd, model).collect()}
    assert scored[0]["score"] == scored[1]["score"] == scored[2]["score"] == 0 and not scored[0]["keep"]
    kept = quality.drop_poor_documents(odd, model)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert quality.drop_poor_documents(none, model).count() == 0
    clash = docs.withColumn("__id", F.lit(1)).withColumn("__label", F.lit(0)).withColumn("statistics", F.lit("x")).withColumn("score", F.lit(7))
    again = quality.train_quality_model(clash, labels)
    assert (again.value == model.value).all() and quality.drop_poor_documents(clash, again).columns == clash.columns
    empty = quality.train_quality_model(none, labels)
    assert len(empty.value) == 0 and quality.score_quality(docs, empty).count() == 240


def statistics_by_loop(text):
    """The statistics of an ASCII text, word by word and line by line."""
    words, tokens, lines = re.findall(r"[A-Za-z0-9]+", text), text.split(), [x for x in text.split("\n") if x]
    low, n = [w.lower() for w in words], len(text)
    kinds = {k: sum(bool(re.match(p, c)) for c in text) / n for k, p in {"letter": "[a-z]", "capital": "[A-Z]", "digit": "[0-9]", "stop": r"[.,;:!?'\"()\-]", "blank": r"\s"}.items()}
    symbol = re.compile(r"[^a-zA-Z0-9.,;:!?'\"()\-\s]")
    some = max(len(words), 1)
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / some, kinds["letter"] + kinds["capital"], kinds["digit"], kinds["stop"], len(symbol.findall(text)) / n, kinds["capital"], kinds["blank"],
        np.log1p(n / max(len(lines), 1)), again / n, len(set(low)) / some, sum(len(w) <= 3 for w in words) / some, max((low.count(w) for w in low), default=0) / some, sum(bool(symbol.search(t)) for t in tokens) / max(len(tokens), 1),
    ]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB3 .#\n\t", min_size=1, max_size=60), min_size=1, max_size=5))
def test_statistics_against_a_plain_loop(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = quality.statistics(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for row, t in zip(got, texts):
        assert row.tolist() == pytest.approx(statistics_by_loop(t))


def test_tree_scores_against_a_walk(spark):
    rng = np.random.default_rng(6)
    good, bad = [prose(random.Random(i), 40) + "." for i in range(40)], [" ".join(rng.choice(["$$", "##", "buy"], 40)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    model = quality.train_quality_model(docs, spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int"))
    assert len(model.value) == 60
    for r in quality.score_quality(docs, model).collect():
        text = (good + bad)[r["doc_id"]]
        x = quality.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total))) and r["keep"] == (r["score"] >= 0.5)


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * rng.standard_normal(600)) > 0).astype(float)
    model = quality.train_trees(x, y, {0: 1, 1: -1})
    for f, sign in ((0, 1), (1, -1)):
        grid = np.repeat(rng.random((40, 3)), 50, 0)
        grid[:, f] = np.tile(np.linspace(0, 1, 50), 40)
        steps = np.diff(model.margin(grid).reshape(40, 50), axis=1) * sign
        assert steps.min() >= -1e-9 and steps.max() > 0


TEXT = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n\t'sdlvreé漢"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_bpe_equals_the_merges_and_round_trips(texts):
    import tiktoken

    ranks = bpe.read_ranks(bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _, _, ids, at, same in bpe.encode_column(pa.array(texts), bpe.VOCABULARY):
        assert same.all()
        back, ends = bpe.encoder().decode_block(ids, at)
        for n, t in enumerate(texts):
            assert ids[at[n] : at[n + 1]].tolist() == own.encode_ordinary(t)
            assert back[ends[n] : ends[n + 1]].tobytes().decode() == t


def test_bpe_survives_equal_hashes(monkeypatch):
    texts = ["one two three", "four five", "", "six"]
    own = bpe.ByteBPE()
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want, at, _ = own.encode_block(data, off)
    own._forget()
    real = bpe.span_hash
    monkeypatch.setattr(bpe, "span_hash", lambda p, a, b: real(p, a, b) % np.uint64(5) if len(a) > 3 else real(p, a, b))
    got, ends, same = own.encode_block(data, off)
    assert got.tolist() == want.tolist() and ends.tolist() == at.tolist() and same.all()


def test_bpe_odd(odd, none):
    rows = bpe.encode_documents(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[0]["token_ids"] is None and by[1]["token_ids"] == []
    assert all(r["round_trip"] for r in rows if r["round_trip"] is not None)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in bpe.decode_documents(bpe.encode_documents(odd)).collect())
    assert got == want and bpe.encode_documents(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=24), st.binary(max_size=24)), min_size=1, max_size=5), st.integers(0, 6))
def test_banded_distance(pairs, tau):
    pairs = [(bytes(c % 3 for c in a), bytes(c % 3 for c in b)) for a, b in pairs]
    sizes = np.array([(len(a), len(b)) for a, b in pairs])
    data = np.frombuffer(b"".join(a + b for a, b in pairs), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes.ravel())])[:-1].reshape(-1, 2)
    wide = np.flatnonzero(sizes.max(1) > tau)
    got = linededup.banded_distance(data, starts[:, 0], sizes[:, 0], starts[:, 1], sizes[:, 1], tau)
    want = np.array([min(edits(a, b), tau + 1) for a, b in pairs])
    assert (got[wide] == want[wide]).all()


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(11)
    lines = [prose(rng, 5) for _ in range(30)]
    for t in list(lines):
        for k in (1, 2, 3):
            v = list(t)
            for _ in range(k):
                at = rng.randrange(len(v))
                rng.choice([lambda: v.pop(at), lambda: v.insert(at, "q"), lambda: v.__setitem__(at, "z")])()
            lines.append("".join(v))
    lines = sorted(set(lines))
    docs = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id long, text string")
    table = {(r["doc_id"], r["line_no"]): (r["d1"], r["d2"]) for r in linededup.line_table(docs).collect()}
    hashes = {lines[i::7][n]: h for (i, n), h in table.items()}
    long = [x for x in lines if len(x.encode()) >= 20]
    want = {tuple(sorted((hashes[a], hashes[b]))) for i, a in enumerate(long) for b in long[:i] if edits(a.encode(), b.encode()) <= 2}
    rows = linededup.near_lines(docs).collect()
    got = {tuple(sorted(((r["a1"], r["a2"]), (r["b1"], r["b2"])))) for r in rows}
    assert got == want and len(rows) == len(want) > 30


def test_cells_are_whole_however_large(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), i) for i, c in enumerate(np.concatenate([np.zeros(90), np.ones(7), rng.integers(2, 30, 120)]))]
    table = spark.createDataFrame(rows, "c long, i long").repartition(5)

    def compare(cols, half):
        key, i = cols
        found = [np.zeros((0, 2), np.int64)]
        for a, b in cells.strips(np.searchsorted(key, key, "right") - np.arange(len(key)) - 1, 50):
            ok = (half[a] == 0) | (half[a] != half[b])
            found.append(np.stack([i[a[ok]], i[b[ok]]], 1))
        return list(np.concatenate(found).T)

    want = sorted((a, b) for c, a in rows for d, b in rows if c == d and a < b)
    for n in (4, 25, 1000):
        got = cells.meet_in_cells(table, compare, ("a", "b"), n).collect()
        assert sorted((min(r), max(r)) for r in got) == want
    assert cells.meet_in_cells(table.limit(0), compare, ("a", "b")).count() == 0


def lines_by_search(texts, copies=None):
    """{(document, line number): (first, copies, removed)} by comparing all lines."""
    copies = copies or {}
    lines = [(i, n, x) for i, t in texts.items() for n, x in enumerate((t or "").split("\n")) if x]
    out, kinds = {}, {x: Counter(x.encode()) for _, _, x in lines}
    known = {}

    def near(x, y):
        b, c = x.encode(), y.encode()
        if min(len(b), len(c)) < 20 or abs(len(b) - len(c)) > 2:
            return False
        if (x, y) not in known:  # two edits change four counts of bytes at most
            known[x, y] = known[y, x] = (kinds[x] - kinds[y]).total() + (kinds[y] - kinds[x]).total() <= 4 and edits(b, c) <= 2
        return known[x, y]

    for i, n, x in lines:
        mine = [(j in copies, j, m) for j, m, y in lines if x == y or near(x, y)]
        if len(mine) > 1:
            out[i, n] = min(mine), len(mine)
    final = {}
    for (i, n), (first, count) in out.items():
        inner = any(k[0] == i and k[1] < n and v[0] == first for k, v in out.items())
        long = len(re.findall(r"[^ \t\r\v\f]+", texts[i].split("\n")[n])) >= 50
        kin = i in copies and copies.get(first[1], first[1]) == copies[i]
        final[i, n] = first[1:], count, inner or ((i, n) != first[1:] and (count > 6 or long) and not kin)
    return final


def test_repeated_lines_against_all_pairs(spark):
    rng = random.Random(4)
    footer, passage = "All rights are reserved by the publisher", prose(rng, 50)
    texts = {i: "\n".join([prose(rng, 9), footer if i % 2 else footer + "!", "Heading", prose(rng, 4)]) for i in range(10)}
    texts |= {10: f"{passage}\nown line", 11: f"other\n{passage}\nother\n\nother", 12: f"{texts[3]}\n{passage}", 13: f"{texts[3]}\n{passage}\nmore", 14: None, 15: ""}
    copies = {12: 3, 13: 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = spark.createDataFrame(list(copies.items()), "doc_id long, group_id long")
    for known, table in (({}, None), (copies, group)):
        rows = linededup.repeated_lines(docs, copies=table).collect()
        got = {(r["doc_id"], r["line_no"]): ((r["first_doc_id"], r["first_line_no"]), r["n_lines"], r["removed"]) for r in rows}
        want = lines_by_search(texts, known)
        assert got == want and len(rows) == len(want) > 20
        left = {r["doc_id"]: r["text"] for r in linededup.drop_repeated_lines(docs, copies=table).collect()}
        for i, t in texts.items():
            assert left[i] == (t if not t else "\n".join(x for n, x in enumerate(t.split("\n")) if not want.get((i, n), (0, 0, False))[2]))


def test_bloom_never_loses(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 4000)
    for most in (1 << 28, 1 << 10):
        words = bloom.build(spark.createDataFrame([(int(k),) for k in keys[:2000]], "h long"), 2000, most)
        assert bloom.may_hold(words, keys[:2000]).all()
    assert bloom.may_hold(bloom.build(spark.createDataFrame([(int(k),) for k in keys[:2000]], "h long"), 2000), keys[2000:]).mean() < 0.02


def test_drop_repeated_lines(spark, odd, none):
    footer = "All rights reserved by the publisher"
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"{prose(rng, 30)}\n\n{footer}\nonce {prose(rng, 20)}", i) for i in range(20)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in linededup.drop_repeated_lines(docs).collect()}
    assert footer in rows[0]["text"] and all(footer not in rows[i]["text"] for i in range(1, 20))
    assert all("once " in rows[i]["text"] and "\n\n" in rows[i]["text"] for i in rows)
    assert rows[3]["n_chars"] == len(rows[3]["text"]) and rows[0]["n_chars"] == 0
    out = linededup.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert linededup.drop_repeated_lines(none).count() == 0 and linededup.repeated_lines(none).count() == 0


def test_chat(spark, odd):
    turns = [("system", "Be brief."), ("user", "What is a lake?\nAnd a river?"), ("assistant", "A lake is still water.\n\n- a river moves"), ("user", "Thanks")]
    rows = [(c, n, r, t) for c in range(30) for n, (r, t) in enumerate(turns)]
    df = spark.createDataFrame([*rows, (99, 0, None, None), (None, 0, "user", "hi"), (98, 0, "user", "")], "conv_id long, turn long, role string, text string")
    model = chat.train_role_model(df)
    got = {r["conv_id"]: r for r in chat.format_transcripts(chat.as_transcripts(df), model).collect()}
    for c in range(30):
        assert got[c]["roles"] == [r for r, _ in turns]
        assert got[c]["rendered"] == "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)
    assert got[98]["n_turns"] == got[99]["n_turns"] == 0 and got[None]["roles"] == ["user"]
    bare = chat.turns_of(model, "Human: hello there\n\nAI: good day\nsecond line\n")
    assert bare == [("user", "hello there"), ("assistant", "good day\nsecond line")]
    assert chat.format_transcripts(chat.as_transcripts(df.limit(0)), chat.train_role_model(df.limit(0))).count() == 0
    assert chat.format_transcripts(odd, model, "doc_id", "text").count() == odd.count()


def path_score(model, text, roles):
    """Log probability of a sequence of roles, written out from the model's definition."""
    lines = text.split("\n")
    marks = chat.markers(lines)
    marked, total, after_blank = any(m for m, _ in marks), 0.0, True
    first = next((n for n, (m, x) in enumerate(marks) if m or x.strip()), len(lines) - 1)
    if len(set(roles[: first + 1])) > 1:
        return -np.inf
    for n, ((mark, rest), role) in enumerate(zip(marks, roles)):
        kind = "marker" if mark else ("blank" if marked else "parted") if after_blank and n else "line"
        if n <= first:
            total += model.start[role] * (n == first)
        else:
            stay, b = model.stay[kind], roles[n - 1]
            total += np.log((stay if b == role else 0.0) + (1 - stay) * np.exp(model.turn[b, role]))
        if rest.strip():
            total += model.symbol[role, chat.line_symbol(rest, bool(mark) or after_blank)]
        if mark:
            total += np.log(model.right_marker if mark == role else (1 - model.right_marker) / 2)
        after_blank = not rest.strip() and mark is None and (n > 0 or not rest)
    return total


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.sampled_from(["User: a?", "AI: b", "- c", "", "what is it?", "Q: d", "A: apples", "plain words go on", "### System"]), min_size=1, max_size=6))
def test_viterbi_against_all_sequences(seed, lines):
    import itertools

    rng = np.random.default_rng(seed)

    def logs(n):
        return np.log(rng.dirichlet(np.ones(n)))

    turn = {(a, b): x for a in chat.ROLES for b, x in zip(chat.ROLES, logs(3))}
    symbol = {(r, k): x for r in chat.ROLES for k, x in enumerate(logs(64))}
    model = chat.RoleModel(dict(zip(chat.ROLES, logs(3))), turn, symbol, right_marker=rng.uniform(0.4, 0.99))
    text = "\n".join(lines)
    best = max(path_score(model, text, p) for p in itertools.product(chat.ROLES, repeat=len(lines)))
    got = tuple(r for r, _, _ in chat.decode_roles(model, text))
    assert path_score(model, text, got) == pytest.approx(best, abs=1e-9)
    assert sum(np.exp(turn[chat.ROLES[0], r]) for r in chat.ROLES) == pytest.approx(1)


def test_lone_letters_are_content():
    assert chat.markers(["A: apples", "b"]) == [(None, "A: apples"), (None, "b")]
    assert [m for m, _ in chat.markers(["Q: why?", "A: so"])] == ["user", "assistant"]


def test_roles_without_markers(spark):
    folder = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    model = chat.train_role_model(turns)
    want = {r["conv_id"]: [t["role"] for t in sorted(r["x"], key=lambda t: t["turn"])] for r in turns.where("trim(text) <> ''").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("x")).collect()}
    bare = chat.as_transcripts(turns, withhold=True)
    got = {r["conv_id"]: r["roles"] for r in chat.format_transcripts(bare, model).collect()}
    without = bare.where(~F.col("transcript").rlike(r"(?m)^(System:|User:|Assistant:|### |<\|)")).count()
    assert without > 30 and np.mean([got[c] == want[c] for c in want]) > 0.9


def test_long_transcript():
    model = chat.RoleModel({r: np.log(1 / 3) for r in chat.ROLES}, {(a, b): np.log(1 / 3) for a in chat.ROLES for b in chat.ROLES}, {(r, s): np.log(1 / 64) for r in chat.ROLES for s in range(64)})
    turns = chat.turns_of(model, "\n".join(f"{'User' if i % 2 else 'AI'}: line {i}\nmore" for i in range(3000)))
    assert len(turns) == 3000 and turns[2999] == ("user", "line 2999\nmore")


@pytest.mark.parametrize("version", [1, 2])
def test_arc_to_warc(spark, version):
    import gzip

    records = [("http://a.org/x y", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nhttp://f.org/ 1.1.1.1 20010203040506 text/html 3\n"), ("dns:a.org", "0.0.0.0", "20010203040506", "text/dns", b"answer"), ("ftp://a.org/f", "-", "20010203", "image/gif", b"")]
    raw = warc.arc_file("t.arc", version, records)
    df = spark.createDataFrame([("plain", raw), ("gz", gzip.compress(raw)), ("cut", raw[:-10]), (None, None), ("empty", b"")], "path string, content binary")
    rows = warc.convert_archives(df).collect()
    plain = [r for r in rows if r["archive"] == "plain"]
    assert [r["warc_type"] for r in plain] == ["warcinfo", "response", "response", "resource"]
    assert [bytes(r["record"]) for r in plain] == [bytes(r["record"]) for r in rows if r["archive"] == "gz"]
    for r, (_, _, _, _, block) in zip(plain[1:], records):
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert rest == block + b"\r\n\r\n" and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block)
    assert plain[1]["target_uri"] == "http://a.org/x%20y" and plain[1]["ip_address"] == "1.2.3.4" and plain[1]["warc_date"] == "2001-02-03T04:05:06Z"
    assert plain[3]["warc_date"] == "2001-02-03T00:00:00Z" and plain[3]["ip_address"] is None
    assert {r["archive"] for r in rows} == {"plain", "gz", "cut"} and len({r["record_id"] for r in plain}) == 4


def test_damaged_archives(spark):
    import gzip

    rng = random.Random(9)
    records = [(f"http://a.org/{i}", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\n" + bytes(rng.randrange(256) for _ in range(30_000))) for i in range(8)]
    raw = warc.arc_file("t.arc", 1, records)
    packed = gzip.compress(raw)
    broken = bytearray(packed)
    broken[len(broken) * 3 // 4] ^= 0xFF
    broken[len(broken) * 3 // 4 + 1 : len(broken) * 3 // 4 + 40] = b"\xff" * 39
    junk = raw.replace(b"\nhttp://a.org/3 ", b"\nnot a header at all\nhttp://a.org/3 ")
    files = [("cut", packed[: len(packed) // 2]), ("broken", bytes(broken)), ("noise", b"\x1f\x8b" + b"x" * 50), ("junk", junk), ("two", gzip.compress(raw[:50_000]) + gzip.compress(raw[50_000:]))]
    df = spark.createDataFrame([(n, c, n) for n, c in files for _ in range(2)], "path string, content binary, record_id string")
    rows = warc.convert_archives(df).collect()
    by = {n: [r for r in rows if r["archive"] == n] for n, _ in files}
    want = [bytes(r["record"]) for r in warc.convert_archives(spark.createDataFrame([("two", raw)], "path string, content binary")).collect()]
    assert [bytes(r["record"]) for r in by["two"]] == want * 2  # an archive that comes twice is converted twice
    for n in ("cut", "broken"):
        assert 2 < len(by[n]) / 2 < 9 and by[n][-1]["truncated"] == "length"
        assert [bytes(r["record"]) for r in by[n][: len(by[n]) // 2 - 1]] == want[: len(by[n]) // 2 - 1]
    assert by["noise"] == [] and len(by["junk"]) == 18
    assert [r["skipped"] for r in by["junk"][:9]] == [0, 0, 0, 0, 19, 0, 0, 0, 0]


def test_pages_odd(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (2, None, "x"), (None, "http://b/", None), (3, " ", "x"), (1, "http://a/", "<p>")], "page_id long, url string, html string")
    got = warc.convert_archives(warc.pack_pages(pages)).where("warc_type = 'response'").collect()
    assert sorted(r["target_uri"] for r in got) == ["http://a/", "http://a/", "http://b/"]
    assert warc.convert_archives(warc.pack_pages(pages.limit(0))).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    slots = tokenstore.PerfectHash.build(keys).slot(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_token_store(spark, odd, none, tmp_path):
    folder = str(tmp_path / "store")
    rows = tokenstore.write_token_store(odd, folder, keys_per_index=4)
    rows.write.format("noop").mode("overwrite").save()
    store = tokenstore.TokenStore(folder)
    texts = {}
    for r in odd.collect():
        if r["doc_id"] is not None and r["text"] is not None:
            texts.setdefault(r["doc_id"], set()).add(r["text"])
    for key, options in texts.items():
        ids = store.get(key)
        assert bpe.encoder().decode_block(ids.astype(np.int64), np.array([0, len(ids)]))[0].tobytes().decode() in options
    assert store.get(0) is None and store.get(12345) is None and rows.count() == len(texts)
    asked = [10, None, 5, 12345, 5, 9]
    got = store.get_many(asked)
    assert [None if x is None else x.tolist() for x in got] == [None if k is None or k == 12345 else store.get(k).tolist() for k in asked]
    keys = spark.createDataFrame([(k, "x") for k in asked] * 3, "doc_id long, token_ids string")
    read = [(r["doc_id"], r["token_ids"]) for r in tokenstore.read_token_store(spark, folder, keys).collect()]
    assert sorted(map(repr, read)) == sorted(repr((k, None if x is None else x.tolist())) for k, x in zip(asked, got) for _ in range(3))
    assert tokenstore.read_token_store(spark, folder, keys.limit(0)).count() == 0
    assert tokenstore.token_store(none).count() == 0


def test_pretokens_are_those_of_the_pattern():
    text = "It's  we'll \n\n x'S 12a é漢 !?' 'tis end   "
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    assert bpe.pretoken_starts(chars, np.array([0, len(chars)])).tolist() == [m.start() for m in regex.finditer(bpe.PATTERN, text)]


def test_pipeline(spark):
    """Each stage against a brute-force version over the stage before it."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], folder).cache() if name != "byte-level BPE" else stage(spark, kept[-1], folder))
    good, lined, single, mixed, ids = kept[1:]
    assert all(x.columns == docs.columns for x in (good, lined, single, mixed))
    texts = [{r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, good, lined, single)]
    # quality rules: the trees, walked by hand elsewhere, say which documents stay
    model = quality.train_quality_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(texts[1]) == {r["doc_id"] for r in quality.score_quality(docs, model).collect() if r["keep"]} and 0 < len(texts[1]) < len(texts[0])
    # near duplicates by all pairs of fingerprints
    def groups(texts):
        names = list(texts)
        fp, has = simhash.fingerprints(pa.array([texts[i] for i in names], pa.string()))
        root = {i: i for i in names}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, i in enumerate(names):
            near = np.bitwise_count(fp[:x] ^ fp[x]).sum(1) <= 32 if has[x] else []
            for y in np.flatnonzero(near):
                if has[y]:
                    a, b = sorted((find(i), find(names[y])))
                    root[b] = a
        return {i: find(i) for i in names}

    copies = {i: g for i, g in groups(texts[1]).items() if i != g}
    removed = {k for k, v in lines_by_search(texts[1], copies).items() if v[2]}
    assert removed and texts[2] == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in removed) for i, t in texts[1].items()}
    assert set(texts[3]) == {i for i, g in groups(texts[2]).items() if i == g} and len(texts[3]) < len(texts[2])
    # mixing, slot by slot
    hashed = single.select("source", F.xxhash64(F.lit(17), *single.columns).alias("x"), "doc_id").collect()
    want = [row for row, *_ in sorted(mixed_by_loop(hashed, 16, 1), key=lambda r: r[4])]
    order = [r["doc_id"] for r in mixed.collect()]
    assert order == want and set(order) == set(texts[3])
    back = bpe.decode_documents(ids).collect()
    assert len(back) == len(order) and all(texts[3][r["doc_id"]] == r["text"] for r in back)
    whole = corpus_pipeline.run(spark, folder).orderBy("mix_position").select("doc_id", "n_tokens").collect()
    assert [r["doc_id"] for r in whole] == order and sum(r["n_tokens"] for r in whole) == ids.agg(F.sum("n_tokens")).first()[0]


def test_pipeline_on_odd_tables(spark, tmp_path, odd):
    import corpus_pipeline

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("odd", plain), ("none", plain.limit(0))):
        folder = f"{tmp_path}/{name}"
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert all(r["round_trip"] for r in rows) and (len(rows) > 0) == (name == "odd")
