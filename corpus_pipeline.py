"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
below the shared folder and gives what it reads again to the next stage. All but the last
return the columns of ``docs``; where a text changes, ``n_chars`` follows it. Extra columns
pass through. Documents leave in two stages only: without a recognisable language, and as near
duplicates of a document that stays.

Nulls, ties and repeats: a null text has no language and goes. Rows that share a doc_id are one
document from the near-duplicate stage on, which keeps the one whose text comes first. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliofleet.llm import language, line_dedup, ngram_join, packing, secrets
from heliofleet.llm.common import id_key, table, work_folder, written

#: Documents with a lower score for their best language go.
MIN_SCORE = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Learns from labelled documents outside fold 0."""
    model = language.fit_language(docs.where(language.fold() != 0))
    told = language.predict_language(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more documents share, but for one holder of each."""
    return _recounted(line_dedup.drop_lines(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates."""
    found = ngram_join.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    kept = found.select(id_key("component_id").alias("id")).distinct()
    # rows that share an id: the one whose text, then whose other columns, come first
    rows = docs.select(id_key().alias("id"), F.struct("text", F.struct(*docs.columns).alias("row")).alias("r"))
    one = rows.join(kept, "id", "left_semi").groupBy("id").agg(F.min("r").alias("r"))
    return one.select(*(F.col("r.row")[c].alias(c) for c in docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return _recounted(secrets.mask_secrets(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and place of each."""
    folder = work_folder(spark, "packing")
    return packing.pack(written(packing.cut_pieces(docs), folder, "pieces")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language ID", identify_language), ("line dedup", dedup_lines), ("near duplicates", dedup_near),
          ("secret scans", mask_secrets), ("best-fit packing", pack_sequences)]

#: Learned weights and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{i}")
    return docs
