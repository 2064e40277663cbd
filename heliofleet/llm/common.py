"""Reading tables, the shared working folder and small helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir

#: A batch that goes to Python holds at most so many rows and bytes, however long its texts are.
BATCH_ROWS = "2000"
BATCH_BYTES = str(4 << 20)
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well: texts range from nothing to many megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # workers on this machine import the package from where the driver has it
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` below ``folder`` and read it again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text only, so that other columns of the input cannot clash."""
    return docs.select("doc_id", "text", *more)


def id_key(column="doc_id"):
    """A document id as a join and sort key; a null id counts as the smallest."""
    return F.coalesce(F.col(column), F.lit(-(1 << 63)))


def salted_rank(df: DataFrame, key: list[str], order: list[str], salts: int, rank: str = "rank"):
    """Number the rows of each key from 0, in a fixed order, without gathering a key in one task.

    Rows of a key are dealt over ``salts`` parts by a hash of ``order``; each part is numbered
    by itself and starts where the parts before it end. ``order`` must tell rows apart; what
    it doesn't is numbered in any order.
    """
    from pyspark.sql import Window

    if salts <= 1:
        return df.withColumn(rank, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = part.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*key, "_salt").orderBy(*order)
    return (part.withColumn("_at", F.row_number().over(inside) - 1)
            .join(starts, [*key, "_salt"])
            .withColumn(rank, (F.col("_from") + F.col("_at")).cast("long"))
            .drop("_salt", "_at", "_from"))
