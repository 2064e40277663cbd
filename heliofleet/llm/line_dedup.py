"""Repeated lines, found by levelled sorted runs of line hashes.

Documents come in batches, the largest ids first. Each batch is reduced to a sorted run of
(line key, documents, holder). Its keys are merge-anti-joined with the runs that exist: a key
that no run has is held by the largest document of this batch; a key that is known only adds
to the number of documents. The batch then adds its own run to level 0. When a level has
FANOUT runs, they are compacted into one run of the next level; a last compaction ends the
job. Runs are tables bucketed and sorted by key in the shared folder, so a merge moves no
run over the network; Spark sorts the rows of a bucket again when it reads them.

Keys are 128-bit digests of the lines, so no text is moved before the last step, where the
texts meet the keys that they lose.

Nulls, ties and repeats: a null text is one empty line. Rows with the same doc_id count as one
document, a null doc_id as the smallest document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, id_key, table, texts_of, work_folder, written

MIN_POINTS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_points: int) -> bytes | None:
    """Digest of the normalised line, or None if it is shorter than ``min_points``."""
    key = line.strip(STRIP)
    if len(key) < min_points or (len(key) < 4 * min_points and len(key.decode()) < min_points):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, min_points: int) -> DataFrame:
    """doc (key of doc_id) and the distinct keys of its lines."""
    def scan(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                own = {line_key(x, min_points) for x in (text.as_py() or b"").split(b"\n")}
                own.discard(None)
                keys.extend(own)
                ids.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())],
                                             names=["doc", "line"])
    return docs.select(id_key().alias("doc"), "text").mapInArrow(scan, "doc long, line binary")


class LineRuns:
    """The levelled runs: tables of (line, docs, holder) below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        # as many buckets as a shuffle has partitions, so that every bucket is written by one task
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        """A run: ``rows``, dealt by repartition(buckets, "line"), as a bucketed and sorted table."""
        name = f"lines_{self.folder.rsplit('-', 1)[-1]}_{self.made}"
        self.made += 1
        (rows.write.bucketBy(self.buckets, "line").sortBy("line").format("parquet")
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def merge(self, batch: DataFrame) -> DataFrame:
        """``batch`` (line, docs, holder) without the holder where a run has the line.

        The anti-join is written as outer joins and a test for no match, since the lines that
        it takes out stay as counts.
        """
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("line", F.lit(True).alias(f"in{i}")), "line", "left")
            known = known | F.coalesce(f"in{i}", F.lit(False))
        return batch.select("line", "docs", F.when(~known, F.col("holder")).alias("holder"))

    def add(self, batch: DataFrame) -> None:
        """Merge a batch of (doc, line), one row per document and line, as a run of its own."""
        own = batch.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("holder"))
        self._put(0, self._write(self.merge(own.repartition(self.buckets, "line"))))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            runs = [self.spark.table(x) for x in self.levels[level]]
            merged = self._write(self._merged(runs).repartition(self.buckets, "line"))
            self.levels[level] = []
            self._put(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Full outer merge joins, bucket by bucket: counts add up, a line has one holder."""
        out = runs[0]
        for run in runs[1:]:
            run = run.select("line", F.col("docs").alias("docs2"), F.col("holder").alias("holder2"))
            out = out.join(run, "line", "full").select(
                "line", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"),
                F.greatest("holder", "holder2").alias("holder"))
        return out

    def compacted(self) -> DataFrame:
        return self._merged(self.runs())

    def close(self) -> None:
        """Take the names out of the session; the files stay in the shared folder."""
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS lines_{self.folder.rsplit('-', 1)[-1]}_{i}")


def repeated_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
                   batches: int = BATCHES) -> DataFrame:
    """doc, lines: per document the keys of the lines that it loses (absent if none)."""
    spark = docs.sparkSession
    folder = work_folder(spark, "lines")
    bounds = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)
                         .alias("b")).first().b or []
    batch = F.lit(0)
    for b in bounds:  # the larger an id, the earlier its batch
        batch = batch + (F.col("doc") <= b).cast("int")
    # repeated rows of a document would count twice; rows of a doc_id are told apart only then
    keys = line_keys(texts_of(docs), min_points).withColumn("batch", batch)
    path = f"{folder}/keys"
    keys.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc long, line binary, batch int").parquet(path)
    runs = LineRuns(spark, folder)
    for i in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == i).select("doc", "line").distinct())
    drop = written(runs.compacted().where(F.col("docs") >= min_docs).select("line", "holder"),
                   folder, "dropped")
    runs.close()
    return lines.join(drop, "line").where(F.col("doc") < F.col("holder")).groupBy("doc").agg(
        F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
               batches: int = BATCHES) -> DataFrame:
    """The columns of ``docs`` plus n_lines and n_dropped; the text has the lines that stay.

    Columns of ``docs`` with these two names give way to the result.
    """
    bounded_batches(docs.sparkSession)
    lost = repeated_lines(docs, min_points, min_docs, batches)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rest = {c: f"c{i}" for i, c in enumerate(kept) if c not in ("doc_id", "text")}
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(c).alias(x) for c, x in rest.items())).alias("_rest"),
                         id_key().alias("_doc"))
    joined = packed.join(lost.withColumnRenamed("doc", "_doc"), "_doc", "left").select(
        "doc_id", "text", "_rest", "lines")

    def cut(batches_):
        for batch in batches_:
            texts, counts, dropped = [], [], []
            for text, lines in zip(batch.column(1), batch.column(3)):
                parts = (text.as_py() or "").split("\n")
                gone = set(lines.as_py() or ())
                stay = parts if not gone else [
                    x for x in parts if line_key(x.encode(), min_points) not in gone]
                counts.append(len(parts))
                dropped.append(len(parts) - len(stay))
                texts.append("\n".join(stay) if gone else text.as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, batch.schema.field(1).type), batch.column(2),
                 pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                names=["doc_id", "text", "_rest", "n_lines", "n_dropped"])

    kinds = joined.schema
    out = joined.mapInArrow(cut, f"doc_id {kinds['doc_id'].dataType.simpleString()}, text string, "
                                 f"_rest {kinds['_rest'].dataType.simpleString()}, n_lines long, n_dropped long")
    named = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*(named[c] if c in named else F.col("_rest")[rest[c]].alias(c) for c in kept),
                      "n_lines", "n_dropped")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(texts_of(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}) s),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
found AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.holder AS gone
  FROM keyed k LEFT JOIN found f ON k.key = f.key),
line_dedup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)"""

OP3_SQL = "WITH" + LINES_SQL.format(docs="documents") + """
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(text) AS kept_sha256 FROM line_dedup"""
