"""Compression of vectors to codes of their parts, by dual-tree Lloyd rounds.

Components become floor(scale * x), and vectors are cut into equal consecutive parts, each
position with a codebook of its own. The vectors lie in chunks. For each part position of a
chunk a balanced tree over its parts is built once and stored: their order, and for each node
the box around its parts and their sum. A codebook gets such a tree too in every round. An
assignment walks both trees together: a pair of nodes is pruned when even the least distance
between its boxes is beyond the greatest distance to another entry node of the same part node.
A part node with one entry left is assigned as a whole, and its cached sum and count go to that
entry. What is left at the leaves, the uncertain parts, is decided by the distances of the
integers. Bounds are integers as well, so the result is that of comparing all pairs.

A round sends one sum and count per codebook component from each task; new codebooks are as
large as entries times vector width, whatever the number of vectors.

Nulls, ties and repeats: a vector that is null, or holds null or non-finite components, is left
out. Vectors shorter than the longest, or than a multiple of the number of parts, count as
filled up with zeros, so an empty vector is all zeros. Rows that repeat a vec_id are rows of
their own; they are ordered by their components where the first codebooks are taken, and a null
vec_id comes last. Equal distances go to the lower entry, also between equal entries. Components
saturate at a bound of 2**27 for vectors of up to 64 components (less for longer ones), which keeps the errors of a vector in a
long, and sums of errors saturate at the largest long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, table, work_folder, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: A chunk holds about so many components, a leaf of its trees about so many parts.
CHUNK_VALUES = 1 << 20
LEAF = 12
MAX_LONG = (1 << 63) - 1


class Tree:
    """A balanced tree over the rows of ``points``, split where a node's box is widest.

    Node i of level l holds order[n * i >> l : n * (i + 1) >> l]; its children are 2i and 2i + 1.
    Per level there are the low and high corners of the boxes.
    """

    def __init__(self, points: np.ndarray, leaf: int, stored=None):
        self.n = len(points)
        self.depth = 0
        while (self.n >> self.depth) > leaf:
            self.depth += 1
        if stored is None:
            self.order = np.arange(self.n)
            self._split(points)
            self.points = points[self.order]
        else:
            self.order, self.points = stored, points
        edges = [(self.n * np.arange((1 << level) + 1, dtype=np.int64)) >> level for level in range(self.depth + 1)]
        self.edges = edges
        self.low, self.high = [], []
        low = high = None
        for level in range(self.depth, -1, -1):
            if low is None:
                low, high = self._boxes(edges[level])
            else:
                low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.low.insert(0, low)
            self.high.insert(0, high)
        self.sums = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)))

    def _split(self, points):
        for level in range(self.depth):
            edges = (self.n * np.arange((1 << level) + 1, dtype=np.int64)) >> level
            now = points[self.order]
            low, high = (f.reduceat(now, edges[:-1], axis=0) for f in (np.minimum, np.maximum))
            node = np.repeat(np.arange(1 << level), np.diff(edges))
            wide = np.argmax(high - low, axis=1)[node]
            self.order = self.order[np.lexsort((now[np.arange(self.n), wide], node))]

    def _boxes(self, edges):
        return (f.reduceat(self.points, edges[:-1], axis=0) for f in (np.minimum, np.maximum))


def entry_tree(entries: np.ndarray) -> Tree:
    """A tree with one entry in each leaf; the last entry fills up to a power of two."""
    n = len(entries)
    rows = np.minimum(np.arange(1 << (n - 1).bit_length()), n - 1)
    tree = Tree(entries[rows], 1)
    tree.order = rows[tree.order]
    return tree


def dual_assign(parts: Tree, book: Tree, entries: np.ndarray, whole: list | None = None) -> np.ndarray:
    """The nearest of ``entries``, whose tree is ``book``, to each row of ``parts.points``.

    ``whole`` collects (nodes, first row, end row, entry) of the part nodes assigned as a whole.
    """
    out = np.full(parts.n, -1, np.int64)
    if not parts.n:
        return out
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = at = 0
    while True:
        # distances of the two boxes, component by component
        pl, ph, el, eh = parts.low[level][p], parts.high[level][p], book.low[at][e], book.high[at][e]
        apart = np.maximum(np.maximum(el - ph, pl - eh), 0)
        across = np.maximum(np.maximum(eh - pl, ph - el), 0)
        least, most = (apart * apart).sum(axis=1), (across * across).sum(axis=1)
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        bound = np.minimum.reduceat(most, first)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        stay = least <= bound[run]
        p, e = p[stay], e[stay]
        if at == book.depth:
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            alone = np.diff(np.append(first, len(p))) == 1
            nodes, chosen = p[first[alone]], book.order[e[first[alone]]]
            if len(nodes):
                start, stop = parts.edges[level][nodes], parts.edges[level][nodes + 1]
                sizes = stop - start
                rows = np.repeat(start - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                out[rows] = np.repeat(chosen, sizes)
                if whole is not None:
                    whole.append((start, stop, chosen))
                left = ~np.repeat(alone, np.diff(np.append(first, len(p))))
                p, e = p[left], e[left]
            if level == parts.depth or not len(p):
                break
        # both trees go down a level, as long as they have one
        if level < parts.depth:
            p, e = np.repeat(p, 2) * 2 + np.tile([0, 1], len(p)), np.repeat(e, 2)
            level += 1
        if at < book.depth:
            p, e = np.repeat(p, 2), np.repeat(e, 2) * 2 + np.tile([0, 1], len(e))
            at += 1
            full = book.edges[at][e + 1] > book.edges[at][e]
            p, e = p[full], e[full]
        by = np.lexsort((e, p))
        p, e = p[by], e[by]
    if len(p):  # the uncertain leaves
        entry = book.order[e]
        by = np.lexsort((entry, p))
        p, entry = p[by], entry[by]
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        width = np.diff(np.append(first, len(p)))
        start, stop = parts.edges[level][p[first]], parts.edges[level][p[first] + 1]
        size = stop - start
        row = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        of = np.repeat(np.arange(len(first)), size)
        much = width[of]
        ends = np.cumsum(much)
        inside = np.arange(ends[-1]) - np.repeat(ends - much, much)
        chosen = entry[np.repeat(first[of], much) + inside]
        gap = np.repeat(parts.points[row], much, axis=0) - entries[chosen]
        far = (gap * gap).sum(axis=1)
        near = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, ends - much), much))
        owner = np.repeat(np.arange(len(row)), much)[near]
        once = np.concatenate(([True], owner[1:] != owner[:-1]))  # the lowest entry of equal ones
        out[row[owner[once]]] = chosen[near[once]]
    return out


def scaled_vectors(vectors: DataFrame, scale: float, parts: int, carry: list[str]) -> tuple[DataFrame, int]:
    """key (vec_id and the carried columns) and v (saturated integer components), and the width."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(
        F.struct(F.col("vec_id").cast("long").alias("vec_id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("key"),
        F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & fine)
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-max(width, 1) // parts) * parts
    most = int(((1 << 60) / max(width, 64)) ** 0.5)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.lit(scale) * x), F.lit(most)), F.lit(-most)).cast("int"))
    return kept.select("key", whole.alias("v")), width


def plant(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """One row per chunk: the keys, and per part position the order and the sorted parts as bytes."""
    limit = max(1, CHUNK_VALUES // width)
    schema = vectors.select(F.array("key").alias("keys")).schema
    kinds = f"keys {schema['keys'].dataType.simpleString()}, orders array<binary>, points array<binary>"

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield chunk(held)
                held, rows = [], 0
        if rows:
            yield chunk(held)

    def chunk(held):
        t = pa.Table.from_batches(held).combine_chunks()
        keys, lists = (t.column(i).combine_chunks() for i in (0, 1))
        sizes = np.diff(lists.offsets.to_numpy())
        full = np.zeros((len(keys), width), np.int64)
        full[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        trees = [Tree(x, LEAF) for x in np.split(full, parts, axis=1)]
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
             pa.array([[x.order.astype("<i4").tobytes() for x in trees]], pa.list_(pa.binary())),
             pa.array([[x.points.astype("<i4").tobytes() for x in trees]], pa.list_(pa.binary()))],
            names=["keys", "orders", "points"])
    return vectors.mapInArrow(run, kinds)


def stored_trees(batch: pa.RecordBatch, row: int, width: int) -> list[Tree]:
    orders, points = batch.column("orders")[row].as_py(), batch.column("points")[row].as_py()
    return [Tree(np.frombuffer(p, "<i4").reshape(-1, width).astype(np.int64), LEAF, np.frombuffer(o, "<i4"))
            for o, p in zip(orders, points)]


def assigned_sums(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """slot (position of a codebook component), n and total over all parts assigned to its entry."""
    parts, entries, width = books.shape

    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        trees = [entry_tree(b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for k, tree in enumerate(stored_trees(batch, row, width)):
                    whole: list = []
                    found = dual_assign(tree, trees[k], books[k], whole)
                    for start, stop, chosen in whole:
                        np.add.at(n[k], chosen, stop - start)
                        np.add.at(total[k], chosen, tree.sums[stop] - tree.sums[start])
                        mark = np.zeros(tree.n + 1, np.int64)
                        np.add.at(mark, start, 1)
                        np.add.at(mark, stop, -1)
                        found = np.where(np.cumsum(mark)[:-1] > 0, -1, found)
                    rest = np.flatnonzero(found >= 0)
                    np.add.at(n[k], found[rest], 1)
                    np.add.at(total[k], found[rest], tree.points[rest])
        used = np.flatnonzero(np.repeat(n.ravel(), width))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(np.repeat(n.ravel(), width)[used]), pa.array(total.ravel()[used])],
            names=["slot", "n", "total"])
    return chunks.select("orders", "points").mapInArrow(run, "slot long, n long, total long").groupBy("slot").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def encoded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """key, code and error of every vector."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    hexed = np.array([f"{i:0{digits}x}" for i in range(entries)])

    def run(batches):
        trees = [entry_tree(b) for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for k, tree in enumerate(stored_trees(batch, row, width)):
                    found = dual_assign(tree, trees[k], books[k])
                    gap = tree.points - books[k][found]
                    back = np.empty(tree.n, np.int64)
                    back[tree.order] = np.arange(tree.n)
                    codes.append(hexed[found[back]])
                    error = error + (gap * gap).sum(axis=1)[back]
                text = codes[0]
                for c in codes[1:]:
                    text = np.char.add(text, c)
                keys = batch.column("keys")[row].values
                yield pa.RecordBatch.from_arrays([keys, pa.array(text.tolist(), pa.string()), pa.array(error, pa.int64())],
                                                 names=["key", "code", "error"])
    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    return chunks.mapInArrow(run, f"key {kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: float = SCALE, carry: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, the ``carry`` columns, code, error of every kept vector; the codebooks as an array by
    part, entry and position). ``vectors`` has vec_id, embedding and the carried columns."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "codes")
    scaled, width = scaled_vectors(vectors, scale, parts, list(carry))
    # at most `entries` rows come to the driver
    first = scaled.orderBy(F.col("key.vec_id").isNull(), "key.vec_id", "v").limit(entries).collect()
    size = width // parts
    start = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r.v)] = r.v
    books = np.stack([start[:, k * size:(k + 1) * size] for k in range(parts)])
    chunks = written(plant(scaled, width, parts), folder, "trees")
    for _ in range(rounds if len(first) else 0):
        flat = books.ravel().tolist()
        for r in assigned_sums(chunks, books).collect():  # at most one row per codebook component
            flat[r.slot] = int(r.total) // r.n
        books = np.array(flat, np.int64).reshape(books.shape)
    coded = (encoded(chunks, books) if len(first) else
             scaled.select("key", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")))
    return coded.select("key.vec_id", *(F.col(f"key.c{i}").alias(c) for i, c in enumerate(carry)), "code", "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the error summed over all rows of a label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX_LONG).cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("_of")).agg(total.cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_of")), "left").drop("_of")


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = compress(vectors, carry=("label",))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(coded, work_folder(spark, "codes"), "coded")
    return label_errors(coded).select("vec_id", "code", "error", "label_error",
                                      F.lit(digest).alias("codebooks_sha256"))


def _assign(k: int) -> str:
    return f"""
d{k} AS (
  SELECT p.vec_id, p.part, p.x, b.entry, list_sum([(p.x[i] - b.y[i]) * (p.x[i] - b.y[i]) FOR i IN range(1, len(p.x) + 1)]) AS d
  FROM p JOIN b{k} b ON p.part = b.part),
a{k} AS MATERIALIZED (
  SELECT vec_id, part, x, entry, d FROM d{k}
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""


def _update(k: int) -> str:
    return f"""
m{k} AS (
  SELECT part, entry, list(y ORDER BY i) AS y FROM (
    SELECT part, entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS y
    FROM a{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, w[part * len(w) // {PARTS} + 1:(part + 1) * len(w) // {PARTS}] AS x
  FROM v, unnest(range({PARTS})) t(part)),
b0 AS MATERIALIZED (
  SELECT p.part, f.entry, p.x AS y FROM p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {ENTRIES}) f USING (vec_id)),
""" + ",".join([_assign(0), _update(0), _assign(1), _update(1), _assign(2)]) + """,
e AS (
  SELECT v.vec_id, label, string_agg(printf('%02x', a2.entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a2 JOIN v USING (vec_id) GROUP BY v.vec_id, label),
c AS (
  SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, c"""
