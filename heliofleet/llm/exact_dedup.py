"""Exact duplicates by a tree of merges over sorted digest runs. DataFrame functions only.

Each row is reduced to a digest of its normalised text. The rows form 2**ROUNDS_LOG2 runs;
in every round the runs whose numbers agree but for the next bits meet, as in a binomial tree,
and a multiway merge keeps, for each digest, its row count and its best row: the longest
original text, then the smallest id. After the last round one run is left, spread over all
tasks by digest. A merge groups by SHA-256 and by the length of the normalised text, so a
retained identifier stands for texts that were verified equal at every level.

Nulls, ties and repeats: a null text is the empty text; all texts of white space only are
equal to it. A null doc_id comes after all others in a tie. Repeated rows count one by one in
``group_size`` and exactly one row of a group is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, texts_of, work_folder, written

SPACES = r"[\x20\x09-\x0D]+"
#: 64 runs, met eight at a time in two rounds.
RUN_BITS = 6
ROUND_BITS = 3


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: digest of the normalised text and what ranks the row."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, "")
    return texts_of(docs).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), body.alias("body"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points")).select(
        "doc_id", "row", "points", F.unhex(F.sha2("body", 256)).alias("digest"),
        F.length("body").cast("long").alias("size"))


def merge_runs(run: DataFrame, bits: int) -> DataFrame:
    """Let 2**bits runs meet: one row per digest stays in each merged run."""
    return run.withColumn("run", F.shiftright("run", bits)).groupBy("run", "digest", "size").agg(
        F.min("best").alias("best"), F.sum("rows").alias("rows"))


def exact_groups(docs: DataFrame, run_bits: int = RUN_BITS, round_bits: int = ROUND_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest (binary) for every row of ``docs``."""
    folder = work_folder(docs.sparkSession, "exact")
    rows = written(digests(docs), folder, "digests")
    best = F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"),
                    "doc_id", "row")
    run = rows.select(F.pmod(F.xxhash64("row"), F.lit(1 << run_bits)).cast("int").alias("run"), "digest",
                      "size", best.alias("best"), F.lit(1).cast("long").alias("rows"))
    left = run_bits
    while left > 0:
        run = merge_runs(run, min(round_bits, left))
        left -= round_bits
        run = written(run.sortWithinPartitions("run", "digest"), folder, f"runs-{max(left, 0)}")
    keepers = run.select("digest", "size", F.col("best.doc_id").alias("keep_id"),
                         F.col("best.row").alias("keep_row"), F.col("rows").alias("group_size"))
    return rows.join(keepers, ["digest", "size"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, CAST(count(*) AS BIGINT) AS group_size,
         first(doc_id ORDER BY points DESC, doc_id) AS keep_id
  FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)"""
