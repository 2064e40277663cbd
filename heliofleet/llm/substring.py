"""Passages that documents share, exactly or nearly, by collinear chaining of k-mer seeds.

Seeds are winnowed word k-mers: of every WINDOW successive k-mers the one with the smallest hash,
so any run of K + WINDOW - 1 common words has a common seed. The first document that has a seed
leads it, and every other occurrence is an anchor to the leader's: a seed in n documents gives
n - 1 anchors, not all pairs, and a passage in n documents gives n - 1 rows. Anchors of two
documents are chained in order of both positions: runs on one diagonal become segments, and the best
chain of segments under a gap cost is found with a Fenwick tree of prefix maxima. Chains end at
gaps over MAX_GAP words. What lies between and beside the words that a chain's seeds hold is then
aligned by the words themselves, fetched for those stretches only, by longest common subsequences
and exact extension until words differ or a text ends. Chains of a single segment are no exception. A chain of MIN_WORDS words or more, of which MIN_IDENTITY are common, is a
passage.

A document's words may be led by several documents, with no chain long enough, although another one
has the whole passage. So runs are looked for as well: every window of MIN_WORDS words that can be
shared, by its seeds, and that no exact passage found before covers, is led by the first document that
has it. Any two documents with MIN_WORDS words in a row in common are passages of each other or of one
leader that has these words. Near passages without such a run meet by their seeds' leaders only.

Nulls, ties and repeats: null texts and texts of fewer than K words share nothing. Ties for the
leader go to the smaller doc_id, then the first place. Rows that repeat a doc_id are one
document, as repeats within a document are not looked for. A null doc_id takes part as the
smallest id and is null in the result. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, id_key, table, texts_of, work_folder, written

K, WINDOW = 8, 16
MIN_WORDS, MIN_IDENTITY = 50, 0.8
MAX_GAP = 64
#: The cost of a word of gap, on either side, in matched words.
GAP_COST = 0.25
#: Words beside a chain that are compared at first, more than winnowing can miss. Where all are equal, the texts are.
MARGIN = 32
#: Stretches that one task takes from one copy of a text.
STRETCHES = 256
#: Texts that are cut into stretches at a time, and words of stretches that leave at a time.
FETCHED, SENT = 64, 1 << 19
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_hashes(text: str | None) -> np.ndarray:
    parts = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every window of ``width`` entries, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def seeds_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, word position and whether it is the text's first place of that seed."""
    w = word_hashes(text)
    n = len(w) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.zeros(n, np.uint64)
    for i in range(K):
        h = (h ^ (h >> np.uint64(29))) * MIX[0] + w[i:n + i] * MIX[1]
    h = (h ^ (h >> np.uint64(32))) * MIX[2]
    width = min(WINDOW, n)
    low = sliding(np.minimum, h, width)
    low = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(sliding(np.maximum, low, width) == h)
    first = np.zeros(len(at), bool)
    first[np.unique(h[at], return_index=True)[1]] = True
    return h[at], at, first


def seed_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [seeds_of(t.as_py()) for t in batch.column(1)]
            if not found:
                continue
            doc = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc), pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
                 pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)),
                 pa.array(np.concatenate([f[2] for f in found]))], names=["doc", "seed", "pos", "first"])
    return docs.select("doc", "text").mapInArrow(run, "doc long, seed long, pos int, first boolean")


def best_chains(segments: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Disjoint chains of ``segments`` (lead start, lead end, start, end), best first.

    A Fenwick tree over the ends in the leader holds the best score plus gap credit of the chains
    that end there; segments enter it once their end in the other document is passed.
    """
    n = len(segments)
    if n == 1:
        return [[0]]
    ends = sorted({s[1] for s in segments})
    rank = {e: i + 1 for i, e in enumerate(ends)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    score, back = [0.0] * n, [-1] * n
    order = sorted(range(n), key=lambda i: (segments[i][2], segments[i][0]))
    done = sorted(range(n), key=lambda i: segments[i][3])
    entered = 0
    from bisect import bisect_right
    for j in order:
        ls, le, s, e = segments[j]
        while entered < n and segments[done[entered]][3] <= s:
            i = done[entered]
            entered += 1
            value = (score[i] + GAP_COST * (segments[i][1] + segments[i][3]), i)
            at = rank[segments[i][1]]
            while at < len(tree):
                if tree[at] < value:
                    tree[at] = value
                at += at & -at
        best, at = (-1e18, -1), bisect_right(ends, ls)
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (ls + s)
        score[j] = e - s
        if gain > 0:
            score[j] += gain
            back[j] = best[1]
    chains, used = [], [False] * n
    for j in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = back[j]
        if chain:
            chains.append(chain[::-1])
    return chains


def chains_of(lpos: np.ndarray, pos: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Chains, as lists of segments, of the anchors of two documents.

    Seeds of one diagonal, at most WINDOW words apart, are chained as one segment. It comes back in the pieces
    that its seeds hold without a gap, as words between seeds may differ.
    """
    diagonal = lpos - pos
    order = np.lexsort((pos, diagonal))
    lpos, pos, diagonal = lpos[order], pos[order], diagonal[order]
    other, apart = np.diff(diagonal) != 0, np.diff(pos)

    def joined(gap):
        cut = np.flatnonzero(other | (apart > gap)) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(pos)])) - 1
        return starts, list(zip(lpos[starts].tolist(), (lpos[stops] + K).tolist(), pos[starts].tolist(), (pos[stops] + K).tolist()))
    starts, segments = joined(WINDOW)
    held_at, held = joined(K)
    first = np.searchsorted(held_at, np.append(starts, len(pos))).tolist()
    out = []
    for chain in best_chains(segments):
        part = [segments[chain[0]]]
        for j in chain[1:]:
            a, b = part[-1], segments[j]
            if max(b[0] - a[1], b[2] - a[3]) > MAX_GAP:
                out.append(part)
                part = []
            part.append(b)
        out.append(part)
    least = MIN_WORDS - 2 * (WINDOW - 1)
    place = {s: i for i, s in enumerate(segments)}
    return [[piece for s in c for piece in held[first[place[s]]:first[place[s] + 1]]]
            for c in out if max(c[-1][1] - c[0][0], c[-1][3] - c[0][2]) >= least]


def chain_table(anchors: DataFrame) -> DataFrame:
    """lead, doc and the segments of every chain; streams over the anchors of document pairs."""
    def rows(pairs):
        lead, doc, flat = [], [], []
        for a, b, lpos, pos in pairs:
            for chain in chains_of(lpos, pos):
                lead.append(a)
                doc.append(b)
                flat.append([x for s in chain for x in s])
        return pa.RecordBatch.from_arrays([pa.array(lead, pa.int64()), pa.array(doc, pa.int64()),
                                           pa.array(flat, pa.list_(pa.int32()))], names=["lead", "doc", "segments"])

    def run(batches):
        held: list = []  # the last pair of documents may go on in the next batch
        for batch in batches:
            data = [batch.column(i).to_numpy() for i in range(4)]
            if held:
                data = [np.concatenate(x) for x in zip(held, data)]
            cut = np.flatnonzero((np.diff(data[0]) != 0) | (np.diff(data[1]) != 0)) + 1
            if not len(cut):
                held = data
                continue
            parts = [np.split(x, cut) for x in data]
            held = [p[-1] for p in parts]
            yield rows((int(a[0]), int(b[0]), c, d) for a, b, c, d in zip(*(p[:-1] for p in parts)))
        if held and len(held[0]):
            yield rows([(int(held[0][0]), int(held[1][0]), held[2], held[3])])
    ordered = anchors.repartition("lead", "doc").sortWithinPartitions("lead", "doc", "pos")
    return ordered.select("lead", "doc", "lpos", "pos").mapInArrow(run, "lead long, doc long, segments array<int>")


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not len(a) or not len(b):
        return 0
    where: dict = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lists_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list of ``column`` starts in the values, with the end of the last, and the values."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64))), column.flatten()


def stretches(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what is to be aligned on one side: before, between and after the segments of each chain.

    The segments of chain i are those from at[i] to at[i + 1], its stretches those from at[i] + i to at[i + 1] + i.
    """
    chain = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = np.arange(len(starts)) + chain
    low, high = (np.zeros(len(starts) + len(at) - 1, np.int64) for _ in range(2))
    first, last = at[:-1] + np.arange(len(at) - 1), at[1:] + np.arange(len(at) - 1)
    low[place + 1], high[place] = ends, starts
    low[first] = np.maximum(0, starts[at[:-1]] - MARGIN)
    high[last] = ends[at[1:] - 1] + MARGIN
    return low, high


def parts_of(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``values`` from ``starts`` on, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def common_runs(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many of at most ``most`` entries are equal from at_a and at_b on, forwards or backwards by ``step``."""
    out = np.zeros(len(most), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        n = out[open_]
        open_ = open_[a[at_a[open_] + step * n] == b[at_b[open_] + step * n]]
        out[open_] += 1
        open_ = open_[out[open_] < most[open_]]
    return out


def aligned(segments: tuple, lead: tuple, doc: tuple) -> list[np.ndarray]:
    """lead start, lead end, start, end and common words of chains.

    ``segments`` are where each chain's begin and a row for each segment; ``lead`` and ``doc`` where each stretch
    begins in the words, and the words.
    """
    at, rows = segments
    (at_a, a), (at_b, b) = lead, doc
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    at_a, at_b = at_a[:-1], at_b[:-1]
    first, last = at[:-1] + np.arange(len(at) - 1), at[1:] + np.arange(len(at) - 1)
    common = np.add.reduceat(rows[:, 3] - rows[:, 2], at[:-1])
    least = np.minimum(size_a, size_b)
    before = common_runs(a, b, (at_a + size_a - 1)[first], (at_b + size_b - 1)[first], least[first], -1)
    after = common_runs(a, b, at_a[last], at_b[last], least[last], 1)
    # between segments: what is equal at both ends is common, the rest is aligned
    middle = np.ones(len(size_a), bool)
    middle[first] = middle[last] = False
    middle = np.flatnonzero(middle & (least > 0))
    chain = np.searchsorted(first, middle, "right") - 1
    at_a, at_b, size_a, size_b, least = (x[middle] for x in (at_a, at_b, size_a, size_b, least))
    head = common_runs(a, b, at_a, at_b, least, 1)
    tail = common_runs(a, b, at_a + size_a - 1, at_b + size_b - 1, least - head, -1)
    found = head + tail
    for i in np.flatnonzero(found < least).tolist():
        found[i] += common_length(a[at_a[i] + head[i]:at_a[i] + size_a[i] - tail[i]],
                                  b[at_b[i] + head[i]:at_b[i] + size_b[i] - tail[i]])
    np.add.at(common, chain, found)
    top, end = rows[at[:-1]], rows[at[1:] - 1]
    return [top[:, 0] - before, end[:, 1] + after, top[:, 2] - before, end[:, 3] + after, common + before + after]


def align_chains(chains: DataFrame, docs: DataFrame) -> DataFrame:
    """chain, lead, doc, lead_start, lead_end, start, end, common, open of ``chains`` (chain, lead, doc, segments).

    ``open`` are chains of which all MARGIN words before or after them are equal.
    """
    def ask(side):
        which = F.col("lead" if side == 0 else "doc")
        return chains.select(which.alias("doc"), "chain", F.lit(side).alias("side"), "segments")
    asked = ask(0).unionByName(ask(1))
    many = asked.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    parts = (F.floor((F.col("n") - 1) / STRETCHES) + 1).cast("long")
    # a text that leads very many chains is taken in several tasks, each for some of them
    copies = many.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    bodies = docs.select("doc", "text").join(copies, "doc")
    asked = asked.join(many, "doc").withColumn("part", F.pmod(F.xxhash64("chain"), parts)).groupBy("doc", "part").agg(
        F.collect_list(F.struct("chain", "side", "segments")).alias("asked"))

    def fetch(batches):
        # so many texts at a time hold STRETCHES chains each at most
        for batch in (b.slice(i, FETCHED) for b in batches for i in range(0, b.num_rows, FETCHED)):
            words = [word_hashes(t.as_py()) for t in batch.column(0)]
            size = np.array([len(w) for w in words], np.int64)
            of_text, wanted = lists_of(batch.column(1))
            chain, side, segments = wanted.flatten()
            at, flat = lists_of(segments)
            at, rows = at // 4, flat.to_numpy().reshape(-1, 4).astype(np.int64)
            right = np.repeat(side.to_numpy() == 1, np.diff(at))
            low, high = stretches(at, np.where(right, rows[:, 2], rows[:, 0]), np.where(right, rows[:, 3], rows[:, 1]))
            bounds = at + np.arange(len(at))
            text = np.repeat(np.repeat(np.arange(len(words)), np.diff(of_text)), np.diff(bounds))
            low, high = np.minimum(low, size[text]), np.minimum(high, size[text])
            sizes = np.maximum(high - low, 0)
            starts, words = low + (np.cumsum(size) - size)[text], np.concatenate(words)
            sent = np.concatenate(([0], np.cumsum(sizes)))
            # chains with about SENT words at a time
            edges = np.searchsorted(sent[bounds], np.arange(SENT, sent[-1], SENT))
            edges = np.unique(np.concatenate(([0], edges, [len(chain)])))
            for i, j in zip(edges.tolist(), edges[1:].tolist()):
                first, last = bounds[i], bounds[j]
                found = parts_of(words, starts[first:last], sizes[first:last]).view(np.int64)
                inner = pa.ListArray.from_arrays(pa.array(sent[first:last + 1] - sent[first], pa.int32()), pa.array(found))
                outer = pa.ListArray.from_arrays(pa.array(bounds[i:j + 1] - first, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([chain.slice(i, j - i), side.slice(i, j - i), outer], names=["chain", "side", "words"])
    got = bodies.join(asked, ["doc", "part"]).select("text", "asked").mapInArrow(
        fetch, "chain long, side int, words array<array<long>>")

    def align(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, flat = lists_of(batch.column(3))
            at, rows = at // 4, flat.to_numpy().reshape(-1, 4).astype(np.int64)
            words = [lists_of(lists_of(batch.column(i))[1]) for i in (4, 5)]
            out = aligned((at, rows), *((x, w.to_numpy()) for x, w in words))
            open_ = (rows[at[:-1], 2] - out[2] >= MARGIN) | (out[3] - rows[at[1:] - 1, 3] >= MARGIN)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *map(pa.array, [*out, open_])],
                                             names=["chain", "lead", "doc", "lead_start", "lead_end", "start", "end", "common", "open"])
    one = got.where("side = 0").select("chain", F.col("words").alias("a"))
    two = got.where("side = 1").select("chain", F.col("words").alias("b"))
    return chains.join(one, "chain").join(two, "chain").select("chain", "lead", "doc", "segments", "a", "b").mapInArrow(
        align, "chain long, lead long, doc long, lead_start long, lead_end long, start long, end long, common long, open boolean")


ENDS = ("lead_start", "lead_end", "start", "end")


def common_end(a: np.ndarray, b: np.ndarray) -> int:
    """How many entries a and b have in common from the first on."""
    done, step = 0, 2 * MARGIN
    n = min(len(a), len(b))
    while done < n:
        differ = np.flatnonzero(a[done:min(n, done + step)] != b[done:min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 4
    return n


def extend(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``found`` (chain, lead, doc, the ends, common) with its ends moved on while words are equal.

    Both texts of a pair of documents meet once, for all its chains.
    """
    pairs = found.groupBy("lead", "doc").agg(F.collect_list(F.struct("chain", *ENDS, "common")).alias("chains"))
    bodies = pairs.join(docs.select(F.col("doc").alias("lead"), F.col("text").alias("lead_text")), "lead").join(docs, "doc")

    def run(batches):
        for batch in batches:
            lead, doc, out = [], [], []
            for a, b, x, y, chains in zip(*(batch.column(i) for i in range(5))):
                x, y = word_hashes(x.as_py()), word_hashes(y.as_py())
                for c in chains.as_py():
                    ls, le, s, e = (c[k] for k in ENDS)
                    before, after = common_end(x[:ls][::-1], y[:s][::-1]), common_end(x[le:], y[e:])
                    out.append((c["chain"], ls - before, le + after, s - before, e + after, c["common"] + before + after))
                lead.append(np.full(len(chains), a.as_py(), np.int64))
                doc.append(np.full(len(chains), b.as_py(), np.int64))
            if out:
                chain, *rest = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([*map(pa.array, (chain, np.concatenate(lead), np.concatenate(doc), *rest))],
                                                 names=["chain", "lead", "doc", *ENDS, "common"])
    return bodies.select("lead", "doc", "lead_text", "text", "chains").mapInArrow(
        run, "chain long, lead long, doc long, lead_start long, lead_end long, start long, end long, common long")


def aligned_passages(chains: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """lead, doc, the ends and common of ``chains``; beside the ends words differ, or a text ends."""
    def best(df, *more):  # rows that repeat a doc_id: the text stands for it that has most of the chain
        return df.groupBy("chain").agg(F.max(F.struct("common", *ENDS, "lead", "doc", *more)).alias("x")).select("chain", "x.*")
    ids = chains.select("doc").union(chains.select("lead")).distinct()
    texts = written(docs.select("doc", "text").join(ids, "doc", "left_semi"), folder, f"{name}-texts")
    found = written(best(align_chains(chains, texts), "open"), folder, name)
    whole, left = (found.where(F.col("open") == x).drop("open") for x in (False, True))
    if not left.isEmpty():
        whole = whole.unionByName(best(extend(left, texts)))
    # chains that have grown to the same passage
    return whole.groupBy("lead", "doc", "lead_start", "start").agg(F.max(F.struct("end", "lead_end", "common")).alias("x")).select(
        "lead", "doc", "lead_start", "x.lead_end", "start", "x.end", "x.common")


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, from running sums of powers."""
    base, back = (np.full(len(words), x, np.uint64) for x in (int(MIX[1]), pow(int(MIX[1]), -1, 1 << 64)))
    base[:1] = back[:1] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(base), dtype=np.uint64)))
    h = (sums[width:] - sums[:-width]) * np.cumprod(back)[:len(words) - width + 1]
    return ((h ^ (h >> np.uint64(29))) * MIX[0]) ^ (h >> np.uint64(32))


def open_windows(n: int, places: np.ndarray, covers: list[tuple[int, int]], width: int) -> np.ndarray:
    """Starts of windows that may be shared: seeds of ``places`` run through them, and no cover holds them whole."""
    places = np.unique(places)
    cut = np.flatnonzero(np.diff(places) > WINDOW) + 1
    change = np.zeros(n + 2, np.int64)
    for part in np.split(places, cut):
        low, high = max(0, int(part[0]) - WINDOW + 1), min(n - width, int(part[-1]) - (width - K + 1 - WINDOW))
        if low <= high:
            change[low] += 1
            change[high + 1] -= 1
    wanted = np.cumsum(change)[:n] > 0
    for start, end in covers:
        wanted[max(0, start):max(0, end - width + 1)] = False
    return np.flatnonzero(wanted)


def run_windows(docs: DataFrame, shared: DataFrame, covers: DataFrame, width: int) -> DataFrame:
    """doc, run, pos of the windows that documents may share, outside of ``covers`` (doc, start, end).

    ``shared`` (seed, lead, doc, pos). Only seeds count that a document other than the leader has
    in a window that no cover holds whole: those of the others are known to be the leader's.
    """
    held = covers.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    settled = F.exists("covers", lambda c: (c["start"] <= F.col("pos") - (width - K)) & (c["end"] >= F.col("pos") + width))
    led = shared.where(F.col("doc") != F.col("lead")).join(held, "doc", "left")
    hot = led.where(~F.coalesce(settled, F.lit(False))).select("seed").distinct()
    places = shared.join(hot, "seed", "left_semi").groupBy("doc").agg(F.collect_list("pos").alias("places"))

    def windows(batches):
        for batch in batches:
            doc, seed, pos = [], [], []
            for d, text, at, held in zip(*(batch.column(i) for i in range(4))):
                words = word_hashes(text.as_py())
                if len(words) < width:
                    continue
                starts = open_windows(len(words), np.array(at.as_py(), np.int64), [(c["start"], c["end"]) for c in held.as_py() or ()], width)
                if len(starts):
                    doc.append(np.full(len(starts), d.as_py(), np.int64))
                    seed.append(window_hashes(words, width)[starts].view(np.int64))
                    pos.append(starts.astype(np.int32))
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (doc, seed, pos)], names=["doc", "run", "pos"])
    return docs.join(places, "doc").join(held, "doc", "left").select("doc", "text", "places", "covers").mapInArrow(
        windows, "doc long, run long, pos int")


def run_chains(windows: DataFrame, width: int) -> DataFrame:
    """lead, doc, segments of the runs of successive windows that a document shares with their leader."""
    leads = windows.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("top"), F.max("doc").alias("last")).where(
        "last > top.doc").select("run", F.col("top.doc").alias("lead"), F.col("top.pos").alias("lpos"))
    met = windows.join(leads, "run").where(F.col("doc") != F.col("lead")).select(
        "lead", "doc", (F.col("lpos") - F.col("pos")).alias("diagonal"), "pos").distinct()
    along = Window.partitionBy("lead", "doc", "diagonal").orderBy("pos")
    runs = met.withColumn("_run", F.col("pos") - F.row_number().over(along)).groupBy("lead", "doc", "diagonal", "_run").agg(
        F.min("pos").alias("s"), (F.max("pos") + width).alias("e"))
    return runs.select("lead", "doc", "diagonal", "s", "e", F.array(
        F.col("s") + F.col("diagonal"), F.col("e") + F.col("diagonal"), "s", "e").alias("segments"))


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """doc_id, start_word, end_word, lead_id, lead_start, lead_end, identity of every passage.

    Word positions count from 0, ends are exclusive: the words beside a passage differ, or a text ends there.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "passages")
    docs = texts_of(docs).select(id_key().alias("doc"), "text")
    seeds = written(seed_table(docs), folder, "seeds")
    leads = seeds.where("first").groupBy("seed").agg(
        F.min("doc").alias("lead"), F.min_by("pos", "doc").alias("lpos"), F.max("doc").alias("last")).where("last > lead")
    shared = written(seeds.join(leads, "seed").select("seed", "lead", "doc", "lpos", "pos"), folder, "shared")
    anchors = shared.where(F.col("doc") != F.col("lead")).select("lead", "doc", "lpos", "pos")
    chains = written(chain_table(anchors).withColumn("chain", F.monotonically_increasing_id()), folder, "chains")
    found = written(aligned_passages(chains, docs, folder, "aligned"), folder, "found")
    longest = F.greatest(F.col("lead_end") - F.col("lead_start"), F.col("end") - F.col("start"))
    kept = (longest >= min_words) & (F.col("common") >= min_identity * longest)
    width = max(min_words, K + WINDOW - 1)
    same = (F.col("end") - F.col("start") >= width) & (
        F.col("common") == F.col("end") - F.col("start")) & (F.col("common") == F.col("lead_end") - F.col("lead_start"))
    runs = written(run_windows(docs, shared, found.where(same), width), folder, "windows")
    # the ends of passages that are known already add nothing
    known = found.where(kept).select("lead", "doc", "lead_start", "lead_end", "start", "end")
    fresh = run_chains(runs, width).alias("r").join(known.alias("k"), (F.col("r.lead") == F.col("k.lead")) & (
        F.col("r.doc") == F.col("k.doc")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (
        F.col("lead_start") < F.col("e") + F.col("diagonal")) & (F.col("s") + F.col("diagonal") < F.col("lead_end")), "left_anti")
    fresh = fresh.select("lead", "doc", "segments")
    fresh = written(fresh.withColumn("chain", F.monotonically_increasing_id()), folder, "runs")
    found = found.unionByName(aligned_passages(fresh, docs, folder, "aligned-runs"))
    null_id = -(1 << 63)
    return found.where(kept).select(
        F.when(F.col("doc") != null_id, F.col("doc")).alias("doc_id"), F.col("start").alias("start_word"),
        F.col("end").alias("end_word"), F.when(F.col("lead") != null_id, F.col("lead")).alias("lead_id"),
        "lead_start", "lead_end", (F.col("common") / longest).alias("identity"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))
