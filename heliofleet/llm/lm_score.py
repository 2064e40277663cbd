"""Language-model scores of texts from a log-frequency Bloom filter of n-gram counts.

Texts are words and one end each. Learning counts words and pairs of neighbours (an end is the
first word's left neighbour) over all training texts: each batch sends its distinct n-grams, as
64-bit hashes with their counts, to the shard that a hash belongs to. A shard quantises a count
to its level among the thresholds ceil(BASE ** i) and puts (n-gram, 1), ... (n-gram, level) into
a Bloom filter of its own, sized for what it holds. A count is read back by probing level after
level until one is missing; it is at least the threshold of the last level and below the next.

The filter is broadcast if its size, which is summed up first, is at most MAX_BROADCAST bytes. Beyond
that, texts are kept in chunks, the distinct n-grams of a chunk go to their shards, and the levels
come back to the chunk: the same scores, at the price of two more shuffles.

The model is a bigram model with a Dirichlet prior on the words' own probabilities:
p(w | v) = (low(vw) + PRIOR p(w)) / (high(v) + PRIOR), p(w) = (low(w) + 0.5) / (N + 0.5 (V + 1)),
with the least count of the n-gram's level above and the greatest of the context's below, so the
probabilities that follow a context don't exceed 1. A pair is probed only if both its words are known.
The HEAD most frequent words, a bounded table, have exact counts. The base score takes exact
counts for all words: those of the table at once, the others in a join, where no word has more
than a HEAD-th of all tokens.

Words are known by 128 bits of hash, and no text but the one in hand is held: batches are bounded in
bytes, very long texts are hashed in slices between words.

Nulls, ties and repeats: a null or empty text is one end. Repeated rows count and are scored
one by one. A null doc_id is not learned from and not held out. Without training texts N and V are 0
and every word has the same probability. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, table, work_folder, written

FOLDS, HELD_OUT = 5, 1
HEAD = 1 << 18
BASE, BITS, PROBES = 1.5, 10, 7
PRIOR = 100.0
MAX_BROADCAST = 128 << 20
#: Occurrences of n-grams for each shard, and bytes of a chunk, scored and hashed at a time.
SHARD_GRAMS = 1 << 20
PIECE, SCORED_PIECE, SLICE = 1 << 22, 1 << 19, 1 << 18

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SINGLE = np.array([128, 64, 32, 16, 8, 4, 2, 1], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


END = tuple(int(x) for x in mix(np.array([1, 2], U)))


class WordHash:
    """Polynomial hashes of words, taken from prefix sums over their bytes."""

    def __init__(self, seed: int):
        self.signs = mix(np.arange(256, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))[LOWER]
        self.factor = int(mix(np.array([seed], U))[0]) | 3
        self.inverse = pow(self.factor, -1, 1 << 64)
        self.seed, self.powers, self.inverses = U(seed), np.ones(0, U), np.ones(0, U)

    def __call__(self, data, starts, ends):
        if len(self.powers) < len(data):
            size = max(len(data), SLICE + (1 << 16))
            self.powers, self.inverses = (np.cumprod(np.concatenate((np.ones(1, U), np.full(size - 1, x, U))))
                                          for x in (self.factor, self.inverse))
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.signs[data] * self.powers[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(U) * self.seed)


class Tokens:
    """Words of a text column: hashes a and b, and the row of each; every row ends with END."""

    def __init__(self):
        self.hashes = WordHash(0x51ED27), WordHash(0x2545F4)

    def __call__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if n else (0, 0)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        bounds = bounds - first
        found = []
        at = 0
        while at < len(data):
            stop = self._cut(data, bounds, at)
            found.append(self._slice(data[at:stop], bounds, at))
            at = stop
        a, b, where = (np.concatenate(x) if found else np.zeros(0, k) for x, k in
                       zip(list(zip(*found)) or [()] * 3, (U, U, np.int64)))
        row = np.searchsorted(bounds, where, "right") - 1
        place = np.arange(len(a)) + row  # one end for each row before it
        ends = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n) if n else np.zeros(0, np.int64)
        out = []
        for x, end in ((a, END[0]), (b, END[1]), (row, None)):
            full = np.empty(len(x) + n, x.dtype)
            full[place] = x
            full[ends] = np.arange(n) if end is None else U(end)
            out.append(full)
        return out

    @staticmethod
    def _cut(data, bounds, at):
        """The next place between words, SLICE bytes on."""
        stop, step = at + SLICE, 1 << 16
        while stop < len(data):
            edge = np.flatnonzero(SPACES[data[stop:stop + step]])
            text_end = int(bounds[np.searchsorted(bounds, stop)])
            place = min(text_end, stop + int(edge[0])) if len(edge) else text_end
            if len(edge) or text_end <= stop + step:
                return place
            stop += step
        return len(data)

    def _slice(self, data, bounds, at):
        word = ~SPACES[data]
        fresh = np.zeros(len(data) + 1, bool)
        inside = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, at + len(data), "right")] - at
        fresh[inside] = True
        fresh[[0, -1]] = True
        starts = np.flatnonzero(word & (fresh[:-1] | ~np.concatenate(([False], word[:-1]))))
        ends = np.flatnonzero(word & (fresh[1:] | ~np.concatenate((word[1:], [False])))) + 1
        a, b = (h(data, starts, ends) for h in self.hashes)
        return a, b, starts + at


def unigram(a: np.ndarray) -> np.ndarray:
    return mix(a ^ U(0xA5A5A5A55A5A5A5A))


def bigrams(a: np.ndarray, row: np.ndarray):
    """Hash of each token with the one before it, and the hash of that one; END before the first."""
    before = np.concatenate((np.array([END[0]], U), a[:-1]))[:len(a)]
    before[np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))] = U(END[0])
    return mix(before * U(0x9E3779B97F4A7C15) + mix(a)), before


def counted(x: np.ndarray, weights=None):
    """Distinct values, sorted, and their counts or summed weights."""
    order = np.argsort(x) if weights is not None else None
    x = np.sort(x) if weights is None else x[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    if weights is None:
        return x[first], np.diff(np.append(first, len(x)))
    return x[first], np.add.reduceat(weights[order], first) if len(x) else weights[:0]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def thresholds(base: float = BASE) -> np.ndarray:
    """The least count of each level, from level 1 on."""
    return np.array(sorted({math.ceil(base ** i) for i in range(int(43 / math.log(base)))}), np.int64)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def first_places(grams: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (n-gram, level) start and how far apart they are."""
    h = mix(grams + np.asarray(level).astype(U) * U(0xD6E8FEB86659FD93))
    return h, (h >> U(17)) * U(0x9E3779B97F4A7C15) | U(1)


def place(h: np.ndarray, size) -> np.ndarray:
    """The bit, among ``size`` ones, that a probe falls on."""
    return (((h >> U(32)) * size) >> U(32)).astype(np.int64)


class Filter:
    """Bloom filters of (n-gram, level), one for each shard, that ``levels`` probes."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, base: float = BASE):
        """``bits`` holds the bytes of the shards one after the other; ``sizes`` says how many each has."""
        self.shards = len(sizes)
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.sizes = (sizes * 8).astype(U)
        self.bits, self.most = bits, len(thresholds(base))

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram; equal ones are probed once."""
        grams, back = np.unique(grams, return_inverse=True)
        out = np.zeros(len(grams), np.int64)
        shard = shard_of(grams, self.shards)
        size, start = self.sizes[shard], self.start[shard]
        alive = np.flatnonzero(size > 0)
        grams, size, start = grams[alive], size[alive], start[alive]
        for level in range(1, self.most + 1):
            h, step = first_places(grams, level)
            where = np.arange(len(h))
            for probe in range(PROBES):
                at = place(h, size[where])
                hit = np.flatnonzero(self.bits[start[where] + (at >> 3)] & SINGLE[at & 7])
                where, step = where[hit], step[hit]
                h = h[hit] + step
            if not len(where):
                break
            alive, grams, size, start = alive[where], grams[where], size[where], start[where]
            out[alive] = level
        return out[back]


def filter_block(grams: np.ndarray, counts: np.ndarray, base: float = BASE) -> tuple[bytes, int]:
    """The bits of one shard for n-grams and their counts, and the number of entries."""
    level = np.searchsorted(thresholds(base), counts, "right")
    total = int(level.sum())
    ends = np.cumsum(level)
    which = np.repeat(np.arange(len(grams)), level)
    inner = np.arange(total) - np.repeat(ends - level, level) + 1
    size = max(64, -(-total * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    h, step = first_places(grams[which], inner)
    for _ in range(PROBES):
        bits[place(h, U(size))] = True
        h = h + step
    return np.packbits(bits).tobytes(), total


class Model:
    """What scoring needs beside the filter: all of bounded size."""

    def __init__(self, tokens: int, distinct: int, texts: int, head: pa.Table, shards: int, prior: float, base: float):
        self.tokens, self.distinct, self.texts, self.shards, self.prior, self.base = tokens, distinct, texts, shards, prior, base
        a = head.column("a").to_numpy().view(U)
        order = np.argsort(a)
        self.a, self.b = a[order], head.column("b").to_numpy().view(U)[order]
        self.n = head.column("n_train").to_numpy()[order]
        # the rows of a bucket, which is the first bits of a hash, start at its entry
        self.shift = U(64 - max(1, 4 * len(a)).bit_length())
        self.buckets = np.searchsorted(self.a >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1).astype(U)).astype(np.int32)
        self.room = tokens + 0.5 * (distinct + 1)

    def head(self, a: np.ndarray, b: np.ndarray):
        """Exact counts, and which words are in the table."""
        count, there = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        bucket = (a >> self.shift).astype(np.int64)
        at, stop = self.buckets[bucket], self.buckets[bucket + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            hit = (self.a[at] == a[left]) & (self.b[at] == b[left])
            there[left[hit]] = True
            count[left[hit]] = self.n[at[hit]]
            more = ~hit & (at + 1 < stop)
            left, at, stop = left[more], at[more] + 1, stop[more]
        return count, there

    def wanted(self, texts: pa.Array, tokens: Tokens) -> np.ndarray:
        """The distinct n-grams whose levels ``score`` asks for."""
        a, b, row = tokens(texts)
        _, there = self.head(a, b)
        return np.unique(np.concatenate((unigram(a[~there]), bigrams(a, row)[0])))

    def score(self, texts: pa.Array, tokens: Tokens, levels):
        """Per row: tokens, known ones and base score of the table's words, score, and other words."""
        a, b, row = tokens(texts)
        n = len(texts)
        count, there = self.head(a, b)
        least = np.concatenate(([0], thresholds(self.base), [1 << 62]))
        found = np.zeros(len(a), np.int64)
        found[~there] = levels(unigram(a[~there]))
        low = np.where(there, count, least[found])
        high = np.where(there, count, np.where(found > 0, least[found + 1] - 1, 0))
        pair, before = bigrams(a, row)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        context = np.concatenate((np.zeros(1, np.int64), high[:-1]))[:len(a)]
        context[first] = self.texts
        both = np.flatnonzero((context > 0) & (low > 0))
        seen = np.zeros(len(a), np.int64)
        seen[both] = least[levels(pair[both])]
        seen = np.minimum(seen, np.minimum(context, high))
        p = (low + 0.5) / self.room
        p = (seen + self.prior * p) / (context + self.prior)
        per_row = lambda w: np.bincount(row, w, minlength=n) if n else np.zeros(0)
        score = per_row(np.log10(p))
        base = per_row(np.where(there, np.log10((count + 0.5) / self.room), 0.0))
        known = per_row(there & (count > 0)).astype(np.int64)
        rest = np.flatnonzero(~there)
        rest = rest[np.lexsort((b[rest], a[rest], row[rest]))]
        ra, rb, rr = a[rest], b[rest], row[rest]
        new = np.flatnonzero(np.concatenate(([True], (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]) | (rr[1:] != rr[:-1])))) if len(rest) else rest
        times = np.diff(np.append(new, len(rest)))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(rr[new], minlength=n)))) if n else np.zeros(1)
        others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [signed(ra[new]), signed(rb[new]), pa.array(times, pa.int64())], names=["a", "b", "n"]))
        return [pa.array(per_row(None).astype(np.int64) if n else np.zeros(0, np.int64)), pa.array(known), pa.array(base),
                pa.array(score), others]


def word_counts(docs: DataFrame) -> DataFrame:
    """a, b, n_all and n_train of every word of ``docs`` (text, train), ends included."""
    def run(batches):
        tokens = Tokens()
        for batch in batches:
            a, b, row = tokens(batch.column(0))
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
            order = np.argsort(a)
            a, b, train = a[order], b[order], train[order]
            # equal hashes a with different b may give several rows; the sums put them right
            first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [signed(a[first]), signed(b[first]), pa.array(np.diff(np.append(first, len(a)))),
                 pa.array(np.add.reduceat(train, first) if len(a) else train)], names=["a", "b", "n_all", "n_train"])
    return docs.select("text", "train").mapInArrow(run, "a long, b long, n_all long, n_train long").groupBy("a", "b").agg(
        F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def bloom_shards(docs: DataFrame, shards: int, base: float = BASE) -> DataFrame:
    """shard, bits and entries of the filter that holds all n-grams of the texts of ``docs``."""
    def gather(batches):
        tokens = Tokens()
        for batch in batches:
            found = []
            for piece in pieces(batch, 0, SCORED_PIECE):
                a, _, row = tokens(piece.column(0))
                found.append(counted(np.concatenate((bigrams(a, row)[0], unigram(a)))))
            if not found:
                continue
            grams, counts = counted(*map(np.concatenate, zip(*found)))
            shard = shard_of(grams, shards)
            first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(grams) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first]), pa.array([grams[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()),
                 pa.array([counts[i:j].astype("<u4").tobytes() for i, j in zip(first, ends)], pa.binary())],
                names=["shard", "grams", "counts"])

    def build(key, rows):
        grams = np.frombuffer(b"".join(rows.column("grams").to_pylist()), U)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4").astype(np.int64)
        bits, entries = filter_block(*counted(grams, counts), base)
        return pa.table({"shard": [key[0].as_py()], "bits": pa.array([bits], pa.binary()), "entries": [entries]})
    return docs.select("text").mapInArrow(gather, "shard long, grams binary, counts binary").groupBy("shard").applyInArrow(
        build, "shard long, bits binary, entries long")


def head_cut(words: DataFrame, head: int) -> int:
    """A count that at most ``head`` words reach, found from the sizes of bounded classes of counts.

    A class is a count down to its first five bits, so there are some hundreds. Words below the cut
    have fewer than about a ``head``-th of all tokens each.
    """
    bits = "greatest(length(bin(n_all)) - 5, 0)"
    kind = F.expr(f"shiftleft(shiftright(n_all, {bits}), {bits})")
    sizes = words.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()
    reached, cut = 0, (1 << 63) - 1
    for r in sorted(sizes, key=lambda r: -r.kind):
        reached += r.n
        if reached > head:
            break
        cut = r.kind
    return cut


SCORED = "n_tokens long, known long, base double, score double, others array<struct<a:long,b:long,n:long>>"


def pieces(batch: pa.RecordBatch, column: int, size: int):
    """Runs of rows with at most ``size`` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def score_batch(batch: pa.RecordBatch, model: Model, tokens: Tokens, levels):
    """row, doc_id, held_out, text to the columns of SCORED, piece by piece: scoring takes many times a text's bytes."""
    for piece in pieces(batch, 3, SCORED_PIECE):
        yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(3)), *model.score(piece.column(3), tokens, levels)],
                                         names=["row", "doc_id", "held_out", *(x.split()[0] for x in SCORED.split(", "))])


def scored_by_broadcast(docs: DataFrame, model: Model, blocks: DataFrame, kinds: str) -> DataFrame:
    """Every task probes the whole filter."""
    sc = docs.sparkSession.sparkContext
    sizes = np.zeros(model.shards, np.int64)
    for r in blocks.select("shard", F.length("bits").alias("n")).collect():
        sizes[r.shard] = r.n
    start, bits = np.concatenate(([0], np.cumsum(sizes))), np.zeros(int(sizes.sum()), np.uint8)
    for r in blocks.select("shard", "bits").toLocalIterator():
        bits[start[r.shard]:start[r.shard + 1]] = np.frombuffer(r.bits, np.uint8)
    shared, told = sc.broadcast(bits), sc.broadcast((model, sizes))
    del bits

    def run(batches):
        (own, sizes), tokens = told.value, Tokens()
        probe = Filter(sizes, shared.value, own.base)
        for batch in batches:
            yield from score_batch(batch, own, tokens, probe.levels)
    return docs.mapInArrow(run, kinds)


def scored_by_shards(docs: DataFrame, model: Model, blocks: DataFrame, kinds: str, folder: str) -> DataFrame:
    """The n-grams of each chunk of texts go to their shards, and their levels come back."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def store(batches):
        for batch in batches:
            for piece in pieces(batch, 3, PIECE):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays([piece.column(0).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 names=["chunk", "body"])

    def opened(body) -> pa.RecordBatch:
        return pa.ipc.open_stream(pa.py_buffer(body.as_py())).read_all().combine_chunks().to_batches()[0]

    def ask(batches):
        tokens = Tokens()
        for batch in batches:
            for chunk, body in zip(batch.column(0), batch.column(1)):
                parts = [told.value.wanted(piece.column(3), tokens) for piece in pieces(opened(body), 3, SCORED_PIECE)]
                grams = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(grams, told.value.shards)), pa.array(np.full(len(grams), chunk.as_py(), np.int64)), signed(grams)],
                    names=["shard", "chunk", "gram"])

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        grams = asked.column("gram").to_numpy().view(U)
        # a Filter of one shard, so n-grams are placed by its own size
        held = np.frombuffer(block.column("bits")[0].as_py() if block.num_rows else b"", np.uint8)
        level = Filter(np.array([len(held)]), held, told.value.base).levels(grams)
        hit = np.flatnonzero(level)
        return pa.table({"chunk": asked.column("chunk").take(hit), "gram": asked.column("gram").take(hit), "level": pa.array(level[hit])})

    def finish(stored: pa.Table, answers: pa.Table) -> pa.Table:
        if not stored.num_rows:
            raise ValueError("levels without a chunk")
        grams, level = answers.column("gram").to_numpy().view(U), answers.column("level").to_numpy()
        order = np.argsort(grams)
        grams, level = grams[order], level[order]

        def levels(x):
            if not len(grams):
                return np.zeros(len(x), np.int64)
            at = np.minimum(np.searchsorted(grams, x), len(grams) - 1)
            return np.where(grams[at] == x, level[at], 0)
        return pa.Table.from_batches(score_batch(opened(stored.column("body")[0]), told.value, Tokens(), levels))

    chunks = written(docs.mapInArrow(store, "chunk long, body binary"), folder, "chunks")
    asked = chunks.mapInArrow(ask, "shard long, chunk long, gram long")
    answers = asked.groupBy("shard").cogroup(blocks.select("shard", "bits").groupBy("shard")).applyInArrow(
        answer, "chunk long, gram long, level long")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kinds)


def lm_scores(docs: DataFrame, held_out, prior: float = PRIOR, head: int = HEAD, base: float = BASE,
              max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``held_out`` is a column expression over docs; rows where it is false are learned from, rows
    where it is null are neither.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "lm")
    flagged = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                          F.coalesce(~held_out, F.lit(False)).alias("train"))
    words = written(word_counts(flagged), folder, "words")
    total = words.agg(F.sum("n_train").alias("tokens"), F.count_if(F.col("n_train") > 0).alias("distinct"),
                      F.sum(F.when((F.col("a") == _signed(END[0])) & (F.col("b") == _signed(END[1])), F.col("n_train"))).alias("texts")).first()
    cut = head_cut(words, head)
    top = words.where(F.col("n_all") >= cut).select("a", "b", "n_train").toArrow()  # at most `head` rows of 24 bytes
    tokens = total.tokens or 0
    shards = max(1, -(-2 * tokens // SHARD_GRAMS))
    model = Model(tokens, total.distinct or 0, total.texts or 0, top, shards, prior, base)
    blocks = written(bloom_shards(flagged.where("train"), shards, base), folder, "filter")
    size = blocks.agg(F.sum(F.length("bits"))).first()[0] or 0
    kinds = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, " + SCORED
    rows = flagged.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = (scored_by_broadcast(rows, model, blocks, kinds) if size <= max_broadcast
              else scored_by_shards(rows, model, blocks, kinds, folder))
    scored = written(scored, folder, "scored")
    count = F.coalesce("n_train", F.lit(0))
    more = (scored.select("row", F.inline("others")).join(words.where(F.col("n_all") < cut).select("a", "b", "n_train"), ["a", "b"], "left")
            .groupBy("row").agg(F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("more_known"),
                                F.sum(F.col("n") * F.log10((count + 0.5) / F.lit(model.room))).alias("more_base")))
    return scored.drop("others").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold == HELD_OUT)
