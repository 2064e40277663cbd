"""Structured Streaming twins of the batch operators.

State is keyed by site and window and dropped by the watermark, so it is bounded by the
allowed delay and not by the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import DAY, ENERGY, EXPORT, PRODUCTION, SITE, TS
from ..session import pin_utc, work_path
from .batch_log import BatchLog, run_into


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt="parquet",
                files_per_trigger=None, pattern=None) -> DataFrame:
    """Stream of the files of a folder (those matching ``pattern``) with zone-less times cast
    to TIMESTAMP (watermarks need it)."""
    pin_utc(spark)
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(path)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name)
                       if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                       for f in schema.fields])


def streaming_rollup(readings: DataFrame, period="1 day", delay="10 minutes", cols=ENERGY):
    """Sums per site and tumbling window; a window is emitted once the watermark passes it."""
    out = (readings.withWatermark(TS, delay).groupBy(SITE, F.window(TS, period).alias("w"))
           .agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols],
                F.count(F.lit(1)).alias("readings")))
    return out.select(SITE, F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), *cols, "readings")


def deduplicate(readings: DataFrame, delay="1 day", keys=(SITE, TS, *ENERGY)) -> DataFrame:
    """Drop resends that arrive within the delay: rows with the same time and the same channels and values."""
    return readings.withWatermark(TS, delay).dropDuplicatesWithinWatermark(list(keys))


def rule_alerts(readings: DataFrame) -> DataFrame:
    """Stateless alerts: negative production and export above production."""
    p, x = F.col(PRODUCTION), F.col(EXPORT)
    rules = F.array_compact(F.array(
        F.when(p < 0, F.lit("negative_production")), F.when(x > p, F.lit("excess_export"))))
    return readings.select(SITE, TS, PRODUCTION, EXPORT, F.explode(rules).alias("alert"))


def run_available(stream: DataFrame, path: str, partition_by=()) -> str:
    """Process what is there, append it to Parquet at ``path`` and stop."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(path).awaitTermination()
    return path


def materialise(stream: DataFrame, name: str) -> DataFrame:
    """Run to a fresh path of the shared folder and read it back."""
    spark = stream.sparkSession
    path = run_available(stream, work_path(spark, name))
    return spark.read.schema(stream.schema).parquet(path)


def window_schema(cols=ENERGY) -> T.StructType:
    return T.StructType([T.StructField(SITE, T.LongType()), T.StructField("window_start", T.TimestampType()),
                         T.StructField("window_end", T.TimestampType()),
                         *[T.StructField(c, T.DoubleType()) for c in cols], T.StructField("readings", T.LongType())])


class WindowTable:
    """A rollup that is complete at any time, open windows included.

    The aggregation runs in update mode: each batch tells the new state of the windows that it
    has touched, late rows among them, and the log keeps it as a version, of which the newest wins.
    Rows later than ``delay`` behind the latest time are dropped by the stream.
    """

    def __init__(self, spark: SparkSession, path: str, period="1 day", delay="2 days", cols=ENERGY, fanout=4):
        self.period, self.delay, self.cols = period, delay, cols
        self.log = BatchLog(spark, path, window_schema(cols), (SITE, "window_start", "window_end"), "window_start", "newest", fanout)

    def run(self, stream: DataFrame) -> DataFrame:
        run_into(streaming_rollup(stream, self.period, self.delay, self.cols), self.log, mode="update")
        return self.log.read()


class DailyTable:
    """A daily table kept by ``foreachBatch`` as a log of batches (see ``BatchLog``).

    ``prefer="sum"`` is for readings: each batch stores its part of every day and reading adds
    the parts up, so the result doesn't depend on how readings fall into batches. For a feed that is
    daily already, ``prefer="current"`` keeps known days and ``prefer="fresh"`` lets the newest batch win.
    """

    RULE = {"sum": "sum", "current": "oldest", "fresh": "newest"}

    def __init__(self, spark: SparkSession, path: str, prefer="sum", fanout=4):
        schema = T.StructType([T.StructField(SITE, T.LongType()), T.StructField(DAY, T.DateType()),
                               T.StructField(PRODUCTION, T.DoubleType())])
        self.log = BatchLog(spark, path, schema, (SITE, DAY), DAY, self.RULE[prefer], fanout)

    @staticmethod
    def parts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(SITE, F.to_date(TS).alias(DAY)).agg(
            F.coalesce(F.sum(PRODUCTION), F.lit(0.0)).alias(PRODUCTION))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        self.log.commit(self.parts(batch), batch_id)

    def run(self, stream: DataFrame) -> DataFrame:
        run_into(stream, self.log, self.parts)
        return self.read()

    def read(self, first_day=None, last_day=None) -> DataFrame:
        return self.log.read(first_day, last_day)
