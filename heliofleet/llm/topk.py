"""Exact top-k search by inner product, with a three-phase uniform threshold.

A score is the sum of SEGMENTS partial scores, one for each segment of the vector's components,
so for every query there is a score list per segment. Candidates lie in blocks; a block holds
its part of all lists. Groups of query blocks meet groups of candidate blocks, as many at a time as
GROUP_BYTES hold, so a block is copied once for each group of the other side. Nothing is broadcast.

1. Each pair of blocks gathers, per query and segment, the k best entries of its lists, with
   their totals, and the smallest partial score of each segment. The k-th best total found
   anywhere is a safe cutoff: k candidates at least reach it.
2. The cutoff goes back to the query blocks. With partial scores counted from their minimum, a
   total that reaches the cutoff has a part of at least a SEGMENTS-th of it, so entries below
   that uniform threshold in all lists need no further look. Of the rest, those whose known
   parts, with the threshold in place of unknown ones, can't reach the cutoff are dropped.
3. The scores of the remaining entries are resolved exactly, and the k best are kept.

Components become floor(scale * x). Partial scores are computed by matrix products in doubles,
which are exact as long as no sum can reach 2**53; blocks that could go beyond use Python's integers.

Nulls, ties and repeats: a vector that is null, or holds null or non-finite components, takes no
part, nor does a null vec_id; shorter vectors count as filled up with zeros, so an empty one scores 0.
Scaled components saturate at 2**26, and scores, which can leave a long only with more than 2,048 such
components, at its bounds. Ties go to the
smaller vec_id. Rows that repeat a vec_id are candidates each; as a query a vec_id counts once,
with its smallest vector. A query's own vec_id is no candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import bounded_batches, table, work_folder, written

SEGMENTS = 4
BLOCK = 2048
QUERY_BLOCK = 512
#: Components of a group of blocks, in bytes; one block at least.
GROUP_BYTES = 16 << 20
#: Up to here doubles hold all integers.
EXACT = 2.0 ** 53
#: Scaled components saturate here, and scores at the bounds of a long.
MOST = 2.0 ** 26
LONGS = -(1 << 63), (1 << 63) - 1


LISTS = pa.schema([("query_id", pa.int64()), ("lows", pa.list_(pa.float64())), ("best", pa.list_(pa.int64()))])
SCORED = pa.schema([(x, pa.int64()) for x in ("query_id", "vec_id", "score")])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def packed(vectors: DataFrame, blocks: int, scale: float, name: str) -> DataFrame:
    """One row per block: its number, the ids and the scaled components as bytes."""
    def pack(key, rows):
        ids = rows.column("vec_id").to_numpy()
        lists = rows.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        width = int(sizes.max()) if len(sizes) else 0
        full = np.zeros((len(ids), width))
        full[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        return pa.table({name: [key[0].as_py()], f"{name}_ids": [ids.astype("<i8").tobytes()],
                         f"{name}_values": [np.clip(np.floor(scale * full), -MOST, MOST).astype("<f8").tobytes()]},
                        schema=pa.schema([(name, pa.int64()), (f"{name}_ids", pa.binary()), (f"{name}_values", pa.binary())]))
    block = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks))
    return vectors.select(block.alias("block"), "vec_id", "v").groupBy("block").applyInArrow(
        pack, f"{name} long, {name}_ids binary, {name}_values binary")


def scores(q: np.ndarray, c: np.ndarray):
    """The partial scores of every segment: an array for each, and a list of no segment is zeros."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    big = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width >= EXACT / 4
    if big:
        q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    return [q[:, s::SEGMENTS] @ c[:, s::SEGMENTS].T if width > s else np.zeros((len(q), len(c)))
            for s in range(SEGMENTS)]


def as_long(x) -> int:
    return min(max(int(x), LONGS[0]), LONGS[1])


def unpack(rows: pa.Table, name: str):
    ids = np.frombuffer(rows.column(f"{name}_ids")[0].as_py(), "<i8")
    return ids, np.frombuffer(rows.column(f"{name}_values")[0].as_py(), "<f8").reshape(len(ids), -1)


def blocks_of(rows: pa.Table, name: str):
    for i in range(rows.num_rows):
        yield unpack(rows.slice(i, 1), name)


def best_totals(qi: np.ndarray, ci: np.ndarray, parts: list, k: int) -> list[list[int]]:
    """For each query the k best totals of the candidates among the k best of a segment."""
    total, own, n = sum(parts), ci[None, :] == qi[:, None], len(ci)
    at = []
    for p in parts:
        row = -p.astype(float)
        row[own] = np.inf
        at.append(np.argpartition(row, min(k, n) - 1, axis=1)[:, :k])
    at = np.sort(np.concatenate(at, axis=1), axis=1)
    fresh = np.concatenate((np.ones((len(qi), 1), bool), at[:, 1:] != at[:, :-1]), axis=1)
    fresh &= ~np.take_along_axis(own, at, axis=1)
    found = np.take_along_axis(total, at, axis=1)
    return [sorted(map(as_long, f[x].tolist()), reverse=True)[:k] for f, x in zip(found, fresh)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of ``vectors`` for each row of ``queries``.

    Both are frames of vec_id and embedding.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "topk")
    vectors, queries = valid_vectors(vectors), valid_vectors(queries)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    (n, width), (n_queries, query_width) = (
        df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first() for df in (vectors, queries))
    blocks, query_blocks = -(-max(1, n) // BLOCK), -(-max(1, n_queries) // QUERY_BLOCK)
    cand = written(packed(vectors, blocks, scale, "c"), folder, "candidates")
    query = written(packed(queries, query_blocks, scale, "q"), folder, "queries")
    room = GROUP_BYTES // (8 * max(1, width, query_width))
    # a few groups for each core, while there are so few
    each = max(1, min(room // BLOCK, -(-blocks // (4 * spark.sparkContext.defaultParallelism))))
    query_each = max(1, room // QUERY_BLOCK)

    def meeting(query):
        """Groups of query blocks with groups of candidate blocks, side by side."""
        def dealt(df, mine, size, other, groups):
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
            return df.select("*", F.floor(F.col(mine[0]) / size).alias(mine), every.alias(other)).groupBy("qs", "cs")
        return dealt(query, "qs", query_each, "cs", -(-blocks // each)).cogroup(
            dealt(cand, "cs", each, "qs", -(-query_blocks // query_each)))

    def gather(asked, held):
        out = []
        for qi, q in blocks_of(asked, "q"):
            lows, best = np.full((len(qi), SEGMENTS), np.inf), [[] for _ in qi]
            for ci, c in blocks_of(held, "c"):
                parts = scores(q, c)
                lows = np.minimum(lows, np.array([p.min(axis=1) for p in parts], float).T)
                best = [sorted(a + b, reverse=True)[:k] for a, b in zip(best, best_totals(qi, ci, parts, k))]
            if held.num_rows:
                out.append(pa.table({"query_id": qi, "lows": pa.array(lows.tolist(), pa.list_(pa.float64())),
                                     "best": pa.array(best, pa.list_(pa.int64()))}))
        return pa.concat_tables(out) if out else LISTS.empty_table()

    lists = written(meeting(query).applyInArrow(gather, "query_id long, lows array<double>, best array<long>"), folder, "lists")
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoff = lists.select("query_id", F.explode("best").alias("score")).withColumn(
        "at", F.row_number().over(kth)).where(F.col("at") <= k).groupBy("query_id").agg(
        F.min("score").alias("cutoff"), F.max("at").alias("n"))
    lows = lists.groupBy("query_id").agg(*(F.min(F.col("lows")[s]).alias(f"low{s}") for s in range(SEGMENTS)))
    # per query block the cutoffs of its queries, in one row
    safe = lows.join(cutoff, "query_id", "left").select(
        F.pmod(F.xxhash64(F.col("query_id"), F.lit(11)), F.lit(query_blocks)).alias("q"),
        F.struct("query_id", F.when(F.col("n") == k, F.col("cutoff").cast("double")).otherwise(float("-inf")).alias("cutoff"),
                 F.array(*(f"low{s}" for s in range(SEGMENTS))).alias("lows")).alias("s"))
    safe = safe.groupBy("q").agg(F.sort_array(F.collect_list("s")).alias("safe"))  # QUERY_BLOCK rows, about
    query = written(query.join(safe.hint("merge"), "q"), folder, "cutoffs")

    def resolved(qi, q, safe, ci, c):
        found = {s["query_id"]: s for s in safe}
        cut = np.array([found[x]["cutoff"] for x in qi.tolist()])
        low = np.array([found[x]["lows"] for x in qi.tolist()]).T
        parts = scores(q, c)
        least = (cut - low.sum(axis=0))[:, None] / SEGMENTS  # the uniform threshold of a part
        bound, reach = np.zeros(parts[0].shape), np.zeros(parts[0].shape, bool)
        for p, lo in zip(parts, low):
            above = (p - lo[:, None]).astype(float)
            over = above >= least - 1e-6 * np.abs(least)
            reach |= over
            bound += np.where(over, above, np.maximum(least, 0))
        left = reach & (bound + low.sum(axis=0)[:, None] >= cut[:, None] - 1e-6 * np.abs(cut)[:, None])
        left &= ci[None, :] != qi[:, None]
        out: tuple = ([], [], [])
        for i in np.flatnonzero(left.any(axis=1)).tolist():
            at = np.flatnonzero(left[i])
            exact = sum(p[i, at] for p in parts)
            order = np.lexsort((ci[at], -exact.astype(float)))[:k] if exact.dtype != object else \
                sorted(range(len(at)), key=lambda j: (-exact[j], ci[at[j]]))[:k]
            out[0].extend([int(qi[i])] * len(order))
            out[1].extend(ci[at[order]].tolist())
            out[2].extend(as_long(x) for x in exact[order])
        return pa.table([pa.array(x, pa.int64()) for x in out], schema=SCORED)

    def resolve(asked, held):
        out = [SCORED.empty_table()]
        for i, (qi, q) in enumerate(blocks_of(asked, "q")):
            safe = asked.column("safe")[i].as_py()
            out.extend(resolved(qi, q, safe, ci, c) for ci, c in blocks_of(held, "c"))
        return pa.concat_tables(out)

    kept = meeting(query).applyInArrow(resolve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
