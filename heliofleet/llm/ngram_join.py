"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles, as 64-bit hashes. Documents with the same set
form a class, which takes part once. All shingles are put into one order, rare ones first, by a
count table of fixed size over all documents. At similarity t, two sets of the sizes x and y can
only be similar if they share max(ceil(t x), ceil(t y)) shingles, and so, for any m, at least m of the
first x - ceil(t x) + m and y - ceil(t y) + m. The shorter prefixes, m = 1, are entered in posting lists,
which give the candidates. Each document lengthens its prefix by the estimated cost of its
candidates; a pair must share the smaller of the two m in the prefixes before it is verified
against the whole sets.

A list may hold a third of all documents, so candidates are not all pairs of a list. Entries of a
list are numbered; neighbours at some distances meet first, in an equi-join on (shingle,
number); the very next one comes along when a list is numbered. Links found join their documents to components, and pairs within a component need no
look any more. Long lists that still have many members outside their largest component get a pivot, the
member that is in most such lists, and members are told by their differences from it. Two members whose differences
are small enough together are similar without a look, and all of those are linked to the member
with the smallest difference; others can only be similar if the differences share enough
shingles, so these have prefixes of their own to meet in. Members far from the pivot get another
one, PIVOTS times. What is left then, in lists that still have several components, meets entry by
entry: each one outside the list's largest component with all of other components. So every pair
of a list is either looked at or known to be connected or too different, and no link between
components is lost.

Nulls, ties and repeats: null texts and texts without words have an empty set and no links. Rows
with the same doc_id are one document, with the links of all its texts; of different texts of one
doc_id, one is compared. A null doc_id takes part as the smallest id and is null in the result.
Texts with fewer words than a shingle have one shingle, the whole sequence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, id_key, salted_rank, table, texts_of, work_folder, written
from .components import components

#: Entries of the count table.
SKETCH_BITS = 18
#: Tables of fixed size are added up and sent in so many parts.
TABLE_PARTS = 64
#: Slots for each key of a table of marks, and the logarithm of the most slots.
MARKS_EACH, MARK_BITS = 16, 26
#: A document's m starts at MATCHES and goes up by one with each doubling of its estimated
#: candidates beyond COST, to MOST_MATCHES; it never exceeds the shingles it must share.
MATCHES, COST, MOST_MATCHES = 8, 64, 16
#: Distances at which the neighbours of a list meet, round by round.
ROUNDS = ((1, 1), (2, 4), (5, 16))
#: Pivots of a long list, one after the other, while more than FEW entries are outside its largest component.
PIVOTS, FEW = 3, 32
LIST_PART = 500_000
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    parts = (text or "").encode().lower().split()
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    k = min(n, words)
    out = np.zeros(n - k + 1, np.uint64) + np.uint64(k)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * MIX[0] + h[i:n - k + 1 + i] * MIX[1]
    out ^= out >> np.uint64(32)
    out *= MIX[2]
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def rare_first(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The order of the sorted set ``s`` by the counts ``often``, equal ones as in ``s``."""
    return np.argsort(often, kind="stable")


def count_table(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all documents fall in each of the 2**SKETCH_BITS entries."""
    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [shingle_set(t.as_py(), words) >> np.uint64(64 - SKETCH_BITS) for t in batch.column(0)]
            if found:
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(total))
        yield parts_of(enumerate(total.reshape(TABLE_PARTS, -1)))

    out = np.zeros((TABLE_PARTS, (1 << SKETCH_BITS) // TABLE_PARTS), np.int64)
    rows = docs.select("text").mapInArrow(count, PART_SCHEMA).repartition("part").mapInArrow(added_up, PART_SCHEMA)
    for r in rows.collect():  # a table of fixed size
        out[r.part] += np.frombuffer(r.cells, np.int64)
    return out.reshape(-1)


PART_SCHEMA = "part int, cells binary"


def parts_of(parts) -> pa.RecordBatch:
    parts = list(parts)
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()),
                                       pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "cells"])


def added_up(batches):
    """Sums of the parts (part, cells) of count tables."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[part] = sums.get(part, 0) + np.frombuffer(cells.as_py(), np.int64)
    yield parts_of(sums.items())


def mark_slot(*key, slots: int):
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def marks(keys: DataFrame, *key) -> tuple[np.ndarray, int]:
    """A table of bits, one of which is set for each key, and its number of slots, which is bounded."""
    n = keys.count()
    slots = 1 << min(max(MARKS_EACH * n, 1 << 12).bit_length(), MARK_BITS)
    size = slots // TABLE_PARTS

    def mark(batches):
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for part in np.unique(at // size):
                here = tables.setdefault(int(part), np.zeros(size, bool))
                here[at[at // size == part] % size] = True
        yield parts_of((part, np.packbits(here)) for part, here in tables.items())

    out = np.zeros((TABLE_PARTS, size // 8), np.uint8)
    at = keys.select(mark_slot(*key, slots=slots).alias("at"))
    for r in at.repartition(F.floor(F.col("at") / size)).mapInArrow(mark, PART_SCHEMA).collect():  # of bounded size
        out[r.part] |= np.frombuffer(r.cells, np.uint8)
    return out.reshape(-1), slots


def marked(spark: SparkSession, table: tuple[np.ndarray, int], *key):
    """Whether a row may have one of the keys of ``table``; true of all that have, and of few others."""
    bits, slots = spark.sparkContext.broadcast(table[0]), table[1]

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        x = at.to_numpy()
        return pa.array((bits.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1)
    return test(mark_slot(*key, slots=slots))


def needed(n, percent: int):
    """The shingles that a set of n must share at least."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, words: int, percent: int, shared) -> DataFrame:
    """doc, n, sig, p (the prefix for one match), m and prefix (rare shingles first) per document."""
    noise = int(np.median(shared.value))

    def run(batches):
        for batch in batches:
            rows: tuple = ([], [], [], [], [])
            for t in batch.column(1):
                s = shingle_set(t.as_py(), words)
                n = len(s)
                often = shared.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = rare_first(s, often)
                need = needed(n, percent)
                p = n - need + 1 if n else 0
                cost = int(np.maximum(often[order[:p]] - noise, 0).sum())
                m = max(1, min(MATCHES + (cost // COST).bit_length(), MOST_MATCHES, need))
                for column, x in zip(rows, (n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), p, m,
                                            s[order[:p + m - 1]].view(np.int64))):
                    column.append(x)
            sizes = np.cumsum([0, *map(len, rows[4])])
            flat = np.concatenate(rows[4]) if rows[4] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()),
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                names=["doc", "n", "sig", "p", "m", "prefix"])
    return docs.select(id_key().alias("doc"), "text").mapInArrow(
        run, "doc long, n long, sig binary, p int, m int, prefix array<long>")


def full_sets(docs: DataFrame, words: int, shared) -> DataFrame:
    """rep, m, prefix, hint, n and tokens (the whole set, rare ones first) for rows of doc, text, m, prefix, hint.

    n is the size of the set, null if the prefix is that of another text of the document.
    """
    def ordered(text):
        s = shingle_set(text, words)
        return s[rare_first(s, shared.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])].view(np.int64)

    def run(batches):
        for batch in batches:
            sets = [ordered(t.as_py()) for t in batch.column(1)]
            sizes = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            n = [len(s) if np.array_equal(s[:len(p)], p.values.to_numpy()) else None for s, p in zip(sets, batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                names=["rep", "m", "prefix", "hint", "n", "tokens"])
    return docs.select(F.col("doc").alias("rep"), "text", "m", "prefix", "hint").mapInArrow(
        run, "rep long, m int, prefix array<long>, hint array<short>, n long, tokens array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those that are similar.

    ``sets`` (rep, m, prefix, hint, n, tokens) is bucketed by rep, so the pairs go to the sets. Only pairs
    that may share enough by their hints, 16 bits of each shingle of the prefix that others have too, take prefixes
    along, and only those that share enough of their prefixes take whole sets. All prefixes have one order, so two sets
    share what their prefixes share and, at most, what comes after the last of these in either set.
    """
    def side(name, *columns):
        return sets.select(F.col("rep").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    # shingles of a whose 16 bits b lacks are not in b
    most_common = F.size("hint_a") - F.size(F.array_except("hint_a", "hint_b"))
    pairs = pairs.join(side("a", "hint", "m"), "a").join(side("b", "hint", "m"), "b").where(
        most_common >= F.least("m_a", "m_b")).select("a", "b")
    common = F.array_intersect("prefix_a", "prefix_b")
    met = pairs.join(side("a", "prefix", "m", "n"), "a").join(side("b", "prefix", "m", "n"), "b").where(
        F.size(common) >= F.least("m_a", "m_b")).withColumn("common", common).withColumn("last", F.element_at("common", -1))
    most = F.size("common") + F.least(*(F.col(f"n_{x}") - F.array_position(f"prefix_{x}", F.col("last")) for x in "ab"))
    enough = F.col("n_a").isNull() | F.col("n_b").isNull() | ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    short = met.where(enough).select("a", "b")
    both = short.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").select(
        "a", "b", F.size("tokens_a").alias("x"), F.size("tokens_b").alias("y"),
        F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"))
    union = F.col("x") + F.col("y") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


def pivot_differences(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pivot, rep, comp, size, far, ball, core, diff for the members of ``entries`` (token, rep, comp, pivot).

    diff are the shingles that only one of member and pivot has, those of the member first. With n
    shingles in a set, two members are similar if far(a) + far(b) <= 2 (100 + percent) * shared, where far is
    (100 + percent) * size - (100 - percent) * n and shared counts the shingles that both diffs have.
    A core member's similar ones are all in the ball.
    """
    members = entries.select("pivot", "rep", "comp").distinct()
    bases = sets.join(members.select(F.col("pivot").alias("rep")).distinct(), "rep", "left_semi").select(
        F.col("rep").alias("pivot"), F.col("tokens").alias("base"))
    both = members.join(sets.select("rep", "tokens"), "rep").join(bases, "pivot").select(
        "pivot", "rep", "comp", F.size("tokens").cast("long").alias("n"),
        F.concat(F.array_except("tokens", "base"), F.array_except("base", "tokens")).alias("diff"))
    reach = 50 / percent + (100 - percent) / (100 + percent) * (1 + 100 / percent)
    size = F.size("diff").cast("long")
    ball = size <= F.col("n") * (reach + 1e-9)
    return both.select("pivot", "rep", "comp", size.alias("size"),
                       ((100 + percent) * size - (100 - percent) * F.col("n")).alias("far"), ball.alias("ball"),
                       (2 * size <= F.col("n")).alias("core"), F.when(ball, F.col("diff")).alias("diff"))


def difference_pairs(balls: DataFrame, percent: int) -> DataFrame:
    """pivot, a, b: members of one ball, in different components, whose differences may share enough.

    ``balls`` (pivot, rep, comp, size, far, diff, nearest). A pair that is not similar for sure must
    share a number of shingles that grows with both distances; so it meets in the first
    size - least number + 1 of both diffs, and at its first common shingle enough of both must be left.
    """
    unit = 2 * (100 + percent)
    least = F.greatest(F.lit(1), F.ceil((F.col("far") + F.col("nearest")) / unit)).cast("int")
    keys = balls.withColumn("least", least).where(F.col("least") <= F.col("size")).select(
        "pivot", "rep", "comp", "far", "size",
        F.posexplode(F.slice("diff", F.lit(1), F.col("size").cast("int") - F.col("least") + 1)).alias("i", "token"))
    # what is left from this shingle on, as the distance that it can bridge
    keys = keys.select("pivot", "token", "rep", "comp", "far", (unit * (F.col("size") - F.col("i"))).alias("left"))
    mixed = keys.groupBy("pivot", "token").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d")
    keys = keys.join(mixed.select("pivot", "token"), ["pivot", "token"], "left_semi")

    def side(name):
        return keys.select("pivot", "token", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "comp", "far", "left")))
    together = F.col("far_a") + F.col("far_b")
    return side("a").join(side("b"), ["pivot", "token"]).where(
        (F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b"))
        & (together <= F.col("left_a")) & (together <= F.col("left_b"))).groupBy(
        F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).agg(F.min("pivot").alias("pivot"))


def similar_by_differences(pairs: DataFrame, balls: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (pivot, a, b), those that are similar; only the differences move, no whole sets."""
    def side(name):
        return balls.select("pivot", F.col("rep").alias(name), F.col("far").alias(f"far_{name}"),
                            F.col("diff").alias(f"diff_{name}"))
    return pairs.join(side("a"), ["pivot", "a"]).join(side("b"), ["pivot", "b"]).where(
        F.col("far_a") + F.col("far_b") <= 2 * (100 + percent) * F.size(F.array_intersect("diff_a", "diff_b"))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "ngram")
    docs = texts_of(docs)
    shared_counts = spark.sparkContext.broadcast(count_table(docs, words))  # of fixed size
    signed = written(signatures(docs, words, percent, shared_counts), folder, "signatures")
    signed_sets = signed.where(F.col("n") > 0)
    # only sets that several documents may have are gathered, with their prefixes
    copied = signed_sets.groupBy("sig", "n").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    several = marked(spark, marks(copied, "sig", "n"), "sig", "n")
    told = signed_sets.withColumn("several", several)
    classes = told.where("several").groupBy("sig", "n").agg(
        F.min(F.struct("doc", "p", "m", "prefix")).alias("r")).select("sig", "n", F.col("r.doc").alias("rep"), "r.p", "r.m", "r.prefix")
    reps = written(classes.unionByName(told.where("NOT several").select("sig", "n", F.col("doc").alias("rep"), "p", "m", "prefix")),
                   folder, "classes")
    # two classes with one smallest document (rows that share a doc_id) are one node: the id
    entries = reps.select("rep", "n", "p", F.posexplode("prefix").alias("at", "token")).select(
        "rep", "n", "token", (F.col("at") < F.col("p")).alias("one"))
    # an entry whose next smaller and next larger set of the list are too different in size meets nobody there
    lists = Window.partitionBy("token")
    fits = (100 * F.lag("n").over(lists.orderBy("n")) >= percent * F.col("n")) | (
        100 * F.col("n") >= percent * F.lead("n").over(lists.orderBy("n")))
    shared = entries.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn(
        "length", F.sum(F.col("one").cast("long")).over(lists)).where("fits").drop("fits")
    # a similar document has at least percent**2 of n shingles to share, so its m is this at least
    least = F.greatest(F.lit(1), F.least(F.lit(MATCHES), F.floor(percent * percent * F.col("n") / 10000)))
    hopeful = written(shared.groupBy("rep").agg(F.min("n").alias("n"), F.collect_list(F.struct("n", "token", "one", "length")).alias("shared"))
                      .where(F.size("shared") >= least), folder, "shared")
    listed = hopeful.select("rep", F.explode(F.filter("shared", lambda x: x.one & (x.length > 1))).alias("x")).select(
        "rep", "x.n", "x.token", "x.length")
    longest = listed.agg(F.max("length")).first()[0] or 0
    list_parts = -(-max(longest, 1) // LIST_PART)
    ranked = salted_rank(listed, ["token"], ["n", "rep"], list_parts, "at")
    if list_parts == 1:  # the next of the list comes along
        follows = Window.partitionBy("token").orderBy("n", "rep")
        ranked = ranked.withColumn("next", F.lead(F.struct("rep", "n")).over(follows))
    postings = written(ranked, folder, "postings")
    # 16 bits of each shingle, from others than the count table takes
    hints = F.transform("shared", lambda x: F.shiftright(F.shiftleft(x.token, 32), 48).cast("short"))
    involved = written(hopeful.where(F.exists("shared", lambda x: x.one & (x.length > 1))).select(
        F.col("rep").alias("doc"), hints.alias("hint")), folder, "involved")
    # of rows that share a doc_id, one text stands for the id
    wanted = marks(involved, "doc")
    short = reps.where(marked(spark, wanted, "rep")).groupBy(F.col("rep").alias("doc")).agg(
        F.min(F.struct("m", "prefix")).alias("r")).join(involved, "doc").select("doc", "r.m", "r.prefix", "hint")
    bodies = docs.select(id_key().alias("doc"), "text").where(marked(spark, wanted, "doc")).join(short, "doc").dropDuplicates(["doc"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sets_{folder.rsplit('-', 1)[-1]}"
    # the join has dealt the texts by the same key, so every bucket is written by one task
    (full_sets(bodies, words, shared_counts).write.bucketBy(buckets, "rep").sortBy("rep")
     .format("parquet").option("path", f"{folder}/sets").saveAsTable(name))
    sets = spark.table(name)
    labels = involved.select(F.col("doc").alias("rep"), F.col("doc").alias("comp"))

    def sized(a, b):
        return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))

    def joined(labels, pairs, name):
        """``labels`` after the similar ones of ``pairs`` are linked."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        folder, f"pairs-{name}")
        return labels if pairs.isEmpty() else linked(labels, similar_pairs(pairs, sets, percent), name)

    def linked(labels, links, name):
        edges = links.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a").join(
            labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b").select(
            F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = components(edges, folder, f"links-{name}")
        return written(labels.join(found.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left")
                       .select("rep", F.coalesce("new", "comp").alias("comp")), folder, f"labels-{name}")

    for lo, hi in ROUNDS:
        if longest <= lo:
            break
        now = postings.where(F.col("length") > lo)
        if (lo, hi) == (1, 1) and list_parts == 1:
            pairs = now.select(F.col("rep").alias("a"), F.col("n").alias("x"), F.col("next.rep").alias("b"), F.col("next.n").alias("y"))
            labels = joined(labels, pairs.where((F.col("a") != F.col("b")) & sized("x", "y")).select("a", "b"), f"{lo}")
            continue
        if (lo, hi) == ROUNDS[0]:
            now = now.withColumn("comp", F.col("rep"))  # nothing is linked yet
        else:  # a list of one component has nothing left to find
            now = now.join(labels, "rep")
            mixed = now.groupBy("token").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d")
            now = written(now.join(mixed.select("token"), "token", "left_semi"), folder, f"entries-{lo}")
            if now.isEmpty():
                longest = 0
                break
        # numbers go to blocks of as many as there are distances, so an entry's neighbours are in two blocks at most
        block = lambda at: F.floor(at / (hi - lo + 1))
        left = now.select("token", F.col("rep").alias("a"), F.col("n").alias("x"), F.col("comp").alias("ca"), F.col("at").alias("i"),
                          F.explode(F.sequence(block(F.col("at") + lo), block(F.col("at") + hi))).alias("block"))
        right = now.select("token", F.col("rep").alias("b"), F.col("n").alias("y"), F.col("comp").alias("cb"),
                           F.col("at").alias("j"), block(F.col("at")).alias("block"))
        labels = joined(labels, left.join(right, ["token", "block"]).where(
            (F.col("j") - F.col("i")).between(lo, hi) & (F.col("ca") != F.col("cb")) & sized("x", "y")).select("a", "b"), f"{lo}")
    reach = ROUNDS[-1][1]
    rest, few = postings.where(F.col("length") > reach + 1).select("token", "rep", "n", "at"), []
    for step in range(PIVOTS if longest > reach + 1 else 0):
        now = rest.join(labels, "rep")
        parts = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        outside = parts.groupBy("token").agg((F.sum("k") - F.max("k")).alias("outside")).where("outside > 0")
        now = written(now.join(outside, "token"), folder, f"entries-long{step}")
        few.append(now.where(F.col("outside") <= FEW).select("token", "rep", "n", "at"))
        now = now.where(F.col("outside") > FEW).drop("outside")
        lists = now.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
        tops = now.join(lists, "rep").groupBy("token").agg(F.max(F.struct("k", "rep")).alias("top"))
        now = written(now.join(tops.select("token", F.col("top.rep").alias("pivot")), "token"), folder, f"entries-pivot{step}")
        rest = now.select("token", "rep", "n", "at")
        if now.isEmpty():
            break
        apart = written(pivot_differences(now, sets, percent), folder, f"apart{step}")
        nearest = apart.groupBy("pivot").agg(F.min(F.struct("far", "rep")).alias("top")).select(
            "pivot", F.col("top.far").alias("nearest"), F.col("top.rep").alias("hub"))
        balls = apart.where("ball").join(nearest, "pivot")
        sure = balls.where("far + nearest <= 0 AND rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        labels = linked(labels, sure, f"sure{step}")
        pairs = written(difference_pairs(balls.drop("comp").join(labels, "rep"), percent), folder, f"pairs-pivot{step}")
        if not pairs.isEmpty():
            labels = linked(labels, similar_by_differences(pairs, apart.where("ball"), percent), f"pivot{step}")
        rest = now.join(apart.where(~F.col("core")).select("pivot", "rep"), ["pivot", "rep"], "left_semi").select(
            "token", "rep", "n", "at")
    if longest > reach + 1:
        for part in few:
            rest = rest.unionByName(part)
        now = rest.join(labels, "rep")
        parts = now.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        largest = parts.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
        largest = largest.where(F.col("comps") > 1).select("token", F.col("top.comp").alias("main"))
        now = written(now.join(largest, "token"), folder, "entries-rest")
        left = now.where(F.col("comp") != F.col("main")).select(
            "token", F.col("rep").alias("a"), F.col("n").alias("x"), F.col("comp").alias("ca"), F.col("at").alias("i"))
        right = now.select("token", F.col("rep").alias("b"), F.col("n").alias("y"), F.col("comp").alias("cb"),
                           F.col("at").alias("j"))
        labels = joined(labels, left.join(right, "token").where(
            (F.col("ca") != F.col("cb")) & sized("x", "y") & (F.abs(F.col("i") - F.col("j")) > reach)).select("a", "b"), "rest")
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay in the shared folder
    found = signed.select("doc", "n", "sig").join(reps.select("sig", "n", "rep"), ["sig", "n"], "left").join(
        labels, "rep", "left")
    null_id = -(1 << 63)
    return found.select(*(F.when(c != null_id, c).alias(name) if name != "n_shingles" else c.alias(name) for c, name in (
        (F.col("doc"), "doc_id"), (F.col("n"), "n_shingles"), (F.coalesce("comp", "rep", "doc"), "component_id"))))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] END)) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  WHERE 100 * p.n >= 90 * q.n AND 100 * q.n >= 90 * p.n
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM w JOIN r ON w.doc_id = r.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""
