"""The trie of conversation prefixes, its subtree totals by parallel tree contraction.

Each conversation may open with the first turns of a shared one. A node is a distinct sequence
of first turns; its key is a digest chained along the turns, made while streaming over the sorted
rows of a conversation, so no conversation is held in memory. Rows are reduced to digests and
lengths before that.

Totals of subtrees are sums, found by contraction in join rounds over the active nodes. A round
rakes the leaves, whose values go to their parents summed up first, and compresses unary chains:
of neighbouring nodes with one child each, those whose hash is smaller than their parent's and their
child's are spliced out, and what they held moves to the edge above their child. So long
chains shrink by a constant share a round as well, and a trie of n nodes is down to its root
after O(log n) rounds. Re-expansion takes the rounds backwards: a spliced node has the total of its
child plus what lay between. All joins are on keys that are unique on both sides; the children of
a node meet in partial sums only. Parents with a share of 1/SHARE of all children or more, at
most SHARE of them, are broadcast when children look up their parents; the others are joined.

The members that end in a node are listed in its digest in one order, so they stream through
one task, as ids only and without being held.

Nulls, ties and repeats: turns are ordered by turn, null first, then by role and text; a null
role or text is empty. Rows that repeat are turns each. Rows without conv_id belong to no
conversation and take no part. An empty table still has its root, with no members: conv_id null
and one leaf, the root itself. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, table, work_folder, written

HEAD_KINDS, GROUP = 6, 100
SHARE = 1000
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), digest of role and text, points (code points of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("pos", F.row_number().over(order)).select(
        "conv", "pos", F.length("text").cast("long").alias("points"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"))


def rebuilt(numbered: DataFrame, group: int = GROUP, kinds: int = HEAD_KINDS) -> DataFrame:
    """The turns of every conversation, its first h replaced by those of its group's first one.

    A conversation without turns has one row, with pos 0.
    """
    heads = numbered.where(F.col("pos") < kinds).select(F.col("conv").alias("base"), F.col("pos").alias("at"),
                                                        "points", "digest")
    convs = numbered.where("pos = 1").select(
        "conv", (F.col("conv") - F.col("conv") % group).alias("base"), head_turns("conv", kinds).alias("h"))
    first = convs.join(heads, (convs.base == heads.base) & (heads["at"] <= convs.h)).select(
        "conv", F.col("at").alias("pos"), "points", "digest")
    own = numbered.where(F.col("pos") > head_turns("conv", kinds))
    nothing = convs.select("conv", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("points"), F.lit(None).cast("binary").alias("digest"))
    return own.select("conv", "pos", "points", "digest").union(first).union(nothing)


def head_turns(conv: str, kinds: int = HEAD_KINDS):
    return F.crc32(F.col(conv).cast("string").cast("binary")) % kinds


def chained(turns: DataFrame) -> DataFrame:
    """key, parent, conv, depth, points, ends for every turn, and for depth 0 of every conversation."""
    def run(batches):
        prev = None  # conv, depth, key, parent, points of the last row
        for batch in batches:
            out = []
            for conv, points, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if prev is not None and prev[2] == conv:
                    out.append((*prev, False))
                    key = hashlib.blake2b(prev[0] + digest, digest_size=16).digest()
                    prev = (key, prev[0], conv, prev[3] + 1, points)
                else:
                    if prev is not None:
                        out.append((*prev, True))
                    prev = (ROOT, None, conv, 0, 0)  # its row with pos 0
            yield rows(out)
        yield rows([] if prev is None else [(*prev, True)])

    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["key", "parent", "conv", "depth", "points", "ends"]

    def rows(found):
        cols = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
    return turns.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "points", "digest").mapInArrow(
        run, "key binary, parent binary, conv long, depth long, points long, ends boolean")


def end_digests(members: DataFrame) -> DataFrame:
    """key, ends_sha256: the conversations that end in each node, streamed in order."""
    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    out += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256(b"%d" % conv)
                else:
                    state.update(b",%d" % conv)
            yield rows(out)
        yield rows([(key, state.hexdigest())] if state else [])

    def rows(found):
        cols = list(zip(*found)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string())],
                                          names=["key", "ends_sha256"])
    return members.where("ends").select("key", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(
        run, "key binary, ends_sha256 string")


def mixed(key, round_: int):
    """A hash of a key that differs from round to round; ties are as rare as equal hashes."""
    return F.xxhash64(key, F.lit(round_))


class Contraction:
    """Sums of ``values`` over all subtrees of ``nodes`` (key, parent and the values, longs).

    Exactly one node, the root, has no parent. Each round is written to the shared folder.
    """

    def __init__(self, nodes: DataFrame, values: list[str], folder: str):
        self.values, self.folder, self.rounds = values, folder, 0
        children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
            F.count(F.lit(1)).alias("n"))
        start = nodes.join(children, "key", "left").select(
            "key", "parent", F.coalesce("n", F.lit(0)).alias("n"), *values,
            *(F.lit(0).cast("long").alias(f"edge_{v}") for v in values), *self._record())
        self.active = [written(start, folder, "active-0")]

    def _record(self):
        """No node was spliced out above this one."""
        return [F.lit(None).cast("binary").alias("spliced"), *(F.lit(None).cast("long").alias(f"above_{v}") for v in self.values)]

    def round(self) -> None:
        """Rake the leaves, then compress chains."""
        self.rounds += 1
        r, old, values = self.rounds, self.active[-1], self.values
        leaf = F.col("n") == 0
        below = old.where(F.col("parent").isNotNull()).groupBy("parent").agg(
            *(F.sum(F.when(leaf, F.col(v) + F.col(f"edge_{v}")).otherwise(0)).alias(f"raked_{v}") for v in values),
            F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("key"))).alias("child"))
        kept = old.where(~leaf).join(below.withColumnRenamed("parent", "key"), "key")
        raked = written(kept.select(
            "key", "parent", F.col("left").alias("n"), *((F.col(v) + F.col(f"raked_{v}")).alias(v) for v in values),
            *(f"edge_{v}" for v in values), F.when(F.col("left") == 1, F.col("child")).alias("child")), self.folder, f"raked-{r}")
        own = mixed("key", r)
        gone = F.coalesce(F.col("parent").isNotNull() & F.col("child").isNotNull() & (own < mixed("parent", r)) & (own < mixed("child", r)),
                          F.lit(False))
        moved = raked.where(gone).select(
            F.col("child").alias("key"), F.col("key").alias("spliced"), F.col("parent").alias("above"),
            *(F.col(v).alias(f"held_{v}") for v in values), *(F.col(f"edge_{v}").alias(f"up_{v}") for v in values))
        hit = F.col("spliced").isNotNull()
        self.active.append(written(raked.where(~gone).join(moved, "key", "left").select(
            "key", F.when(hit, F.col("above")).otherwise(F.col("parent")).alias("parent"), "n", *values,
            *(F.when(hit, F.col(f"edge_{v}") + F.col(f"held_{v}") + F.col(f"up_{v}")).otherwise(F.col(f"edge_{v}")).alias(f"edge_{v}")
              for v in values), "spliced",
            *(F.when(hit, F.col(f"edge_{v}") + F.col(f"held_{v}")).alias(f"above_{v}") for v in values)),
            self.folder, f"active-{r}"))

    def totals(self) -> DataFrame:
        """key and the total of every value over its subtree."""
        while self.active[-1].where("n > 0").count():  # a number a round
            self.round()
        values = self.values
        # a node without children has its own total when it is raked; the root is the last of them
        known = [rows.where("n = 0").select("key", *values) for rows in self.active]
        for r in range(self.rounds, 0, -1):
            spliced = self.active[r].where(F.col("spliced").isNotNull()).select(
                "key", "spliced", *(f"above_{v}" for v in values))
            later = known[r]
            for more in known[r + 1:]:
                later = later.union(more)
            found = spliced.join(later, "key").select(
                F.col("spliced").alias("key"), *((F.col(v) + F.col(f"above_{v}")).alias(v) for v in values))
            # spliced in round r: known to all earlier rounds
            known[r - 1] = known[r - 1].union(written(found, self.folder, f"found-{r}"))
        out = known[0]
        for more in known[1:]:
            out = out.union(more)
        return out


def parent_ids(nodes: DataFrame) -> DataFrame:
    """key, parent_conv: the smallest member of each node's parent, without one hot parent in a task."""
    least = nodes.agg(F.count(F.lit(1))).first()[0] // SHARE
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), "n_children")
    hot = parents.where(F.col("n_children") > least)  # fewer than SHARE rows
    children = nodes.where(F.col("parent").isNotNull()).select("key", "parent")
    told = children.join(F.broadcast(hot.select("parent", F.col("parent_conv").alias("hot_conv"))), "parent", "left")
    told = written(told, work_folder(nodes.sparkSession, "trie"), "children")
    rest = told.where(F.col("hot_conv").isNull()).join(
        parents.where(F.col("n_children") <= least).select("parent", "parent_conv"), "parent").select("key", "parent_conv")
    return told.where(F.col("hot_conv").isNotNull()).select("key", F.col("hot_conv").alias("parent_conv")).union(rest)


def prefix_trie(turns: DataFrame, group: int = GROUP, kinds: int = HEAD_KINDS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "trie")
    numbered = written(numbered_turns(turns), folder, "turns")
    members = written(chained(rebuilt(numbered, group, kinds)), folder, "members")
    shape = members.groupBy("key").agg(
        F.min("conv").alias("conv"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("points").alias("points"))
    if members.isEmpty():  # the root stands without members
        shape = shape.union(spark.range(1).select(
            F.lit(ROOT), F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"),
            F.lit(0).cast("long"), F.lit(0).cast("long")))
    children = shape.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    saved = F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("points")
    nodes = written(shape.join(children, "key", "left").select(
        "key", "parent", "conv", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        saved.alias("saved_tokens")), folder, "nodes")
    leaves = (F.col("n_children") == 0).cast("long")
    totals = Contraction(nodes.select("key", "parent", leaves.alias("n_leaves"), "saved_tokens"),
                         ["n_leaves", "saved_tokens"], folder).totals()
    return (nodes.drop("saved_tokens").join(totals, "key").join(parent_ids(nodes), "key", "left")
            .join(end_digests(members), "key", "left").select(
                F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
                "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# crc32 of the decimal digits, bit by bit; a node is named by its smallest member and depth
OP13_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t),
crc AS (
  SELECT c, xor(4294967295, list_reduce(
    list_prepend(4294967295, [CAST(ascii(s[i]) AS BIGINT) FOR i IN range(1, length(s) + 1)]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]),
      lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM bytes),
r AS (
  SELECT c, pos, role, text FROM t JOIN crc USING (c) WHERE pos > h
  UNION ALL
  SELECT crc.c, pos, role, text FROM crc JOIN t ON t.c = crc.c - crc.c % 100 AND pos <= h),
l AS (
  SELECT crc.c, coalesce(turns, []) AS turns FROM crc LEFT JOIN (
    SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM r GROUP BY c) g USING (c)),
m AS MATERIALIZED (SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM l, unnest(range(len(turns) + 1)) u(d)),
k AS MATERIALIZED (
  SELECT path, d, min(c) AS conv, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path, d),
n AS MATERIALIZED (
  SELECT k.*, p.conv AS parent_conv,
         CASE WHEN k.d = 0 THEN 0 ELSE (k.n_convs - 1) * length(k.path[k.d]['text']) END AS own
  FROM k LEFT JOIN k p ON p.d = k.d - 1 AND p.path = k.path[1:k.d - 1]),
c AS MATERIALIZED (
  SELECT n.conv, n.d, n.own, n.path, count(x.conv) AS kids FROM n LEFT JOIN n x ON x.d = n.d + 1 AND x.parent_conv = n.conv GROUP BY ALL),
s AS (
  SELECT top.conv, top.d, sum(CASE WHEN c.kids = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(c.own) AS saved
  FROM c, unnest(range(c.d + 1)) u(up) JOIN n top ON top.d = up AND top.path = c.path[1:up] GROUP BY ALL)
SELECT n.conv AS conv_id, n.d AS depth, n.parent_conv AS parent_conv_id, n.n_convs, c.kids AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN c ON n.conv = c.conv AND n.d = c.d JOIN s ON n.conv = s.conv AND n.d = s.d"""
