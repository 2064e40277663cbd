"""Daily or interval tables stored so that work per site moves no rows.

Rows are bucketed by site and sorted by site and time inside a bucket, below a folder per year.
A window, aggregation or join by site over the stored table starts from the buckets as they are.
Writing again replaces the years that the new rows touch and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import DAY, SITE, TS


def write_clustered(df: DataFrame, table: str, path: str, buckets: int = 32) -> str:
    """Create ``table`` at ``path``, or replace in it the years that ``df`` has rows of.

    ``buckets`` holds for the life of the table: about the number of tasks that should work on it.
    """
    spark = df.sparkSession
    stamp = DAY if DAY in df.columns else TS
    rows = df.withColumn("year", F.year(stamp))
    if not spark.catalog.tableExists(table):
        (rows.repartition(buckets, SITE).write.format("parquet").partitionBy("year").bucketBy(buckets, SITE)
         .sortBy(SITE, stamp).option("path", path).saveAsTable(table))
        return table
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        columns = spark.table(table).columns
        rows.select(*columns).repartition(buckets, SITE).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    return table


def read_clustered(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
