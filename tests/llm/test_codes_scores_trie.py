"""Vector codes, language-model scores and prefix tries against plain versions, odd cases among them."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliofleet.llm import lm_score, prefix_trie, vector_codes


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- vector codes ---

def plain_codes(vectors, parts=16, entries=64, rounds=2, saturate=1 << 27):
    kept = [(i, v, label) for i, v, label in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(v) for _, v, _ in kept] or [1]) // parts) * parts
    width = max(width, parts)
    ints = [[max(-saturate, min(saturate, math.floor(256 * np.float32(x)))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i][:len(kept[i][1])]))[:entries]
    size = width // parts
    cut = [[x[p * size:(p + 1) * size] for p in range(parts)] for x in ints]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for x in cut:
                groups[nearest(x[p], book)[1]].append(x[p])
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(book)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    return Counter((k[0], k[2], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for k, f in zip(kept, found)), books


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(7)
    data = [(i, [rnd.gauss(0, 1) for _ in range(32)], i % 3 if i % 5 else None) for i in range(150)]
    hot = [0.5] * 32
    data += [(200 + i, hot, 1) for i in range(120)]  # a common vector
    data += [(5, data[5][1], 2), (5, data[6][1], 2), (None, data[7][1], 0), (400, None, 1), (401, [1.0, None] * 16, 1),
             (402, [float("nan")] * 32, 1), (403, [float("inf")] * 32, 1), (404, [], 1), (405, [1.0] * 7, None), (406, [3e6] * 32, 1),
             (-3, data[9][1], 0)]
    frame = spark.createDataFrame(data, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    return data, frame.withColumn("code", F.lit("x")).withColumn("key", F.lit(1)).withColumn("v", F.lit(2.0))


def test_codes_equal_the_plain_lloyd(vectors):
    data, frame = vectors
    want, books = plain_codes(data)
    coded, got_books = vector_codes.compress(frame.repartition(3), carry=("label",))
    assert Counter((r["vec_id"], r["label"], r["code"], r["error"]) for r in rows(coded)) == want
    assert got_books.tolist() == books
    sums = defaultdict(int)
    for (_, label, _, error), n in want.items():
        sums[label] += n * error
    assert {(r["label"], r["label_error"]) for r in rows(vector_codes.label_errors(coded))} == set(sums.items())


def test_codes_of_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    coded, books = vector_codes.compress(empty, carry=("label",))
    assert rows(vector_codes.label_errors(coded)) == [] and books.size == 0
    few = spark.createDataFrame([(3, [1.0] * 16, 1), (1, [2.0] * 16, 1), (2, [2.0] * 16, 1)], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    got = {r["vec_id"]: (r["code"], r["error"]) for r in rows(vector_codes.compress(few)[0])}
    # entries 0 and 1 are equal: the lower one wins
    assert got == {1: ("00" * 16, 0), 2: ("00" * 16, 0), 3: ("02" * 16, 0)}


@pytest.mark.parametrize("n, k, width, spread", [(1, 1, 2, 3), (700, 64, 4, 2), (700, 37, 4, 60), (300, 5, 1, 3), (40, 64, 3, 1)])
def test_dual_trees_find_the_nearest(n, k, width, spread):
    rng = np.random.default_rng(n + k)
    points, entries = (np.round(rng.normal(size=(m, width)) * spread).astype(np.int64) for m in (n, k))
    points[: n // 3] = points[0]
    tree, whole = vector_codes.Tree(points, vector_codes.LEAF), []
    found = np.empty(n, np.int64)
    found[tree.order] = vector_codes.dual_assign(tree, vector_codes.entry_tree(entries), entries, whole)
    assert (found == ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    if n == 700 and spread == 60:
        assert whole  # nodes of equal points are assigned at once


# --- language-model scores ---

def words(text):
    return [*(text or "").encode().lower().split(), None]


def plain_base(docs):
    train = [words(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    return n, [(i, len(words(t)), sum(w in count for w in words(t)), sum(math.log10((count[w] + .5) / (n + .5 * (v + 1))) for w in words(t)))
               for i, t in docs]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(rnd.choice(pool[:1 + int(300 * rnd.random() ** 3)]) for _ in range(rnd.randint(1, 60)))) for i in range(300)]
    return data + [(1000, None), (1001, ""), (1002, " \t\n\x0b\x0c\r "), (1003, "x" * 700_000), (1004, "Word wORD\x1cword " * 40_000),
                   (1005, "é日本🙂 É x"), (7, data[7][1]), (7, data[7][1]), (None, "w1 w2"), (1006, "one two")]


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


@pytest.mark.parametrize("head", [lm_score.HEAD, 20, 0])
def test_base_scores_are_exact(corpus, docs_of, head):
    n, want = plain_base(corpus)
    got = rows(lm_score.lm_scores(docs_of(corpus).repartition(3), held(), head=head))
    assert {r["train_tokens"] for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for mine, plain in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert mine[:3] == plain[:3] and mine[3] == pytest.approx(plain[3], rel=1e-9)
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i, _ in corpus if i is not None and zlib.crc32(str(i).encode()) % 5 == 1}


def test_scores_follow_the_model(corpus, docs_of):
    train = [words(t) for i, t in corpus if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t))
    least = lm_score.thresholds().tolist()
    low = lambda c: max([x for x in least if x <= c], default=0)
    room = sum(one.values()) + .5 * (len(one) + 1)

    def score(text):
        out = 0.0
        for before, w in zip([None, *text], text):
            p = (one[w] + .5) / room
            # the table of frequent words holds all words here, so their counts are exact
            out += math.log10((low(two[before, w]) + lm_score.PRIOR * p) / (one[before] + lm_score.PRIOR))
        return out
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in rows(lm_score.lm_scores(docs_of(corpus), held())))
    want = sorted((i or -1, len(words(t)), score(words(t))) for i, t in corpus)
    off = [abs(a[2] - b[2]) / b[1] for a, b in zip(got, want)]
    assert np.mean(off) < 0.02 and sum(x < 1e-9 for x in off) > 0.5 * len(off)  # false members of the filter are few
    # what follows a context sums up to 1 at most
    for before in (b"w0", b"w5", None):
        total = sum((low(two[before, w]) + lm_score.PRIOR * (one[w] + .5) / room) / (one[before] + lm_score.PRIOR) for w in one)
        assert 0.7 < total <= 1


def test_both_ways_of_probing_agree(corpus, docs_of):
    docs = docs_of(corpus).repartition(4)
    for head in (lm_score.HEAD, 50):
        a, b = (sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["score"]) for r in rows(
            lm_score.lm_scores(docs, held(), head=head, max_broadcast=most))) for most in (1 << 30, -1))
        assert a == b


def test_scores_without_texts_or_training(docs_of):
    assert rows(lm_score.lm_scores(docs_of([]), held())) == []
    got = rows(lm_score.lm_scores(docs_of([(1, "a b"), (2, None)]), F.lit(True)))
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 2


def test_filter_holds_levels_from_below():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    counts = np.maximum(1, rng.pareto(0.8, len(grams)).astype(np.int64))
    bits, entries = lm_score.filter_block(grams, counts)
    probe = lm_score.Filter(np.array([len(bits)]), np.frombuffer(bits, np.uint8))
    want = np.searchsorted(lm_score.thresholds(), counts, "right")
    got = probe.levels(grams)
    assert (got >= want).all() and (got > want).mean() < 0.03 and entries == want.sum()
    assert (probe.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.03


# --- prefix tries ---

def plain_trie(data):
    talks = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in talks.items()}
    paths = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(talks.get(c - int(math.fmod(c, 100)), [])[:h] + talks[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    members.setdefault((), [])
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m, default=None), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == p).encode()).hexdigest()) for p, m in members.items())


def trie_rows(spark, data):
    frame = spark.createDataFrame(data, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").withColumn("key", F.lit(1)).withColumn("depth", F.lit("x"))
    return Counter(tuple(r.values()) for r in rows(prefix_trie.prefix_trie(frame.repartition(3))))


def test_trie_equals_the_plain_one(spark):
    rnd = random.Random(11)
    data = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice("abc") * rnd.randint(0, 3)) for c in rnd.sample(range(700), 160)
            for t in range(rnd.randint(1, 7))]
    data += [(c, t, "user", "hot") for c in range(1000, 1060) for t in range(3)]  # a common conversation
    data += [(5000, None, None, None), (5000, None, "", ""), (5000, 1, "é", "日本🙂"), (5000, 1, "é", "日本🙂"), (None, 1, "user", "lost"),
             (5001, 2, "a", "b"), (5001, 2, "ab", ""), (-3, 0, "user", "minus")]
    assert trie_rows(spark, data) == plain_trie(data)


def test_long_chains_take_few_rounds(spark):
    data = [(0, t, "user", str(t)) for t in range(400)] + [(1, t, "user", str(t) if t < 300 else "x") for t in range(350)]
    frame = spark.createDataFrame(data, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    seen = []
    one = prefix_trie.Contraction.round
    try:
        prefix_trie.Contraction.round = lambda self: (seen.append(1), one(self))[1]
        got = Counter(tuple(r.values()) for r in rows(prefix_trie.prefix_trie(frame)))
    finally:
        prefix_trie.Contraction.round = one
    assert got == plain_trie(data) and len(seen) < 30


def test_trie_of_nothing(spark):
    assert trie_rows(spark, [(None, 1, "user", "x")]) == plain_trie([])


def test_scoring_holds_little_beside_a_batch():
    """Four megabytes of text are scored a piece at a time, with the same scores as in one go."""
    import tracemalloc

    rnd = np.random.default_rng(8)
    words = np.array([f"w{i:x}" for i in range(30000)])
    texts = [" ".join(words[rnd.integers(0, len(words), 400)]) for _ in range(1700)] + [None, ""]
    tokens = lm_score.Tokens()
    a, b, row = tokens(pa.array(texts))
    seen, first, n = np.unique(a, return_index=True, return_counts=True)
    head = pa.table({"a": lm_score.signed(seen[:9000]), "b": lm_score.signed(b[first[:9000]]), "n_train": n[:9000]})
    bits, _ = lm_score.filter_block(*lm_score.counted(np.concatenate((lm_score.bigrams(a, row)[0], lm_score.unigram(a)))))
    model = lm_score.Model(int(n.sum()), len(seen), len(texts), head, 1, 100.0, 1.5)
    probe = lm_score.Filter(np.array([len(bits)]), np.frombuffer(bits, np.uint8))
    ids = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], names=["row", "doc_id", "held_out", "text"])
    whole = model.score(batch.column(3), tokens, probe.levels)
    tracemalloc.start()
    found = []
    for piece in lm_score.score_batch(batch, model, tokens, probe.levels):
        found.append(piece.column(6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.chunked_array(found).combine_chunks().equals(whole[3])
    assert peak < 40 << 20
