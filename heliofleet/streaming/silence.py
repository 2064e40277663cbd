"""Alerts for sites that fall silent, raised by event-time timers over keyed state.

A site's state holds its open runs of readings: normally one, more only while late rows may
still join them. A site has one timer, at the last reading of its first run plus the allowed silence.
When the watermark passes it, whether or not the site ever reports again, all runs that the
watermark has passed give their alerts at once, and the timer moves on to the first one left. The
clock of the stream can be moved by heartbeats, rows with a time and no site, so that sites
are found silent even when no other site reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import SITE, TS
from ..session import work_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = f"{SITE} BIGINT, run_start TIMESTAMP, last_seen TIMESTAMP, readings BIGINT, silent_before_seconds BIGINT, alert STRING"


def silence_processor(silence_ms: int):
    """The processor as a class of its own, so that workers get it by value."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class Silence(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState(
                "runs", "first ARRAY<BIGINT>, last ARRAY<BIGINT>, n ARRAY<BIGINT>, before BIGINT")

        def _load(self):
            if not self.state.exists():
                return [], None
            first, last, n, before = self.state.get()
            return [list(r) for r in zip(first, last, n)], before

        def _store(self, runs, before):
            self.state.update(([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], before))

        def handleInputRows(self, key, rows, timerValues):
            if key[0] is None:  # a heartbeat has moved the watermark, which is all it is for
                return iter(())
            runs, before = self._load()
            timer = runs[0][1] if runs else None
            runs += [[ms, ms, 1] for ms in (r.ms for r in rows)]
            runs.sort()
            joined = []
            for run in runs:
                if joined and run[0] - joined[-1][1] < silence_ms:
                    joined[-1][1] = max(joined[-1][1], run[1])
                    joined[-1][2] += run[2]
                else:
                    joined.append(run)
            if timer != joined[0][1]:
                if timer is not None:
                    self.handle.deleteTimer(timer + silence_ms)
                self.handle.registerTimer(joined[0][1] + silence_ms)
            self._store(joined, before)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            runs, before = self._load()
            due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
            at = 0  # runs are in order and apart, so their ends are in order too
            while at < len(runs) and runs[at][1] + silence_ms <= due:
                run = runs[at]
                gap = None if before is None else (run[0] - before) // 1000
                yield Row(site=key[0], first=run[0], last=run[1], n=run[2], gap=gap)
                before = run[1]
                at += 1
            if at < len(runs):
                self.handle.registerTimer(runs[at][1] + silence_ms)
            self._store(runs[at:], before)

        def close(self):
            pass

    return Silence()


def silence_alerts(readings: DataFrame, step_seconds=900, delay="10 minutes", beats: DataFrame | None = None) -> DataFrame:
    """One row per run of readings once no reading came within 1.5 steps of its last one.

    ``beats`` is a stream with a time column: the heartbeats. ``silent_before_seconds`` is the time
    since the site's previous run.
    """
    rows = readings.select(SITE, TS)
    if beats is not None:
        rows = rows.unionByName(beats.select(F.lit(None).cast("bigint").alias(SITE), TS))
    keyed = rows.withWatermark(TS, delay).withColumn("ms", F.unix_millis(TS))
    found = keyed.groupBy(SITE).transformWithState(
        statefulProcessor=silence_processor(int(step_seconds * 1500)),
        outputStructType="site BIGINT, first BIGINT, last BIGINT, n BIGINT, gap BIGINT",
        outputMode="append", timeMode="eventTime")
    return found.select(
        F.col("site").alias(SITE), F.timestamp_millis("first").alias("run_start"), F.timestamp_millis("last").alias("last_seen"),
        F.col("n").alias("readings"), F.col("gap").alias("silent_before_seconds"), F.lit("gap").alias("alert"))


class SilenceWatch:
    """Runs the alerts into a folder, and goes on from its checkpoint at the next call."""

    def __init__(self, spark: SparkSession, readings: DataFrame, step_seconds=900, delay="10 minutes", path=None):
        self.spark, self.path = spark, path or work_path(spark, "silence")
        self.beats = f"{self.path}-beats"
        schema = "ts TIMESTAMP"
        spark.createDataFrame([], schema).write.mode("append").parquet(self.beats)
        beats = spark.readStream.schema(schema).parquet(self.beats)
        self.alerts = silence_alerts(readings, step_seconds, delay, beats)

    def run(self) -> DataFrame:
        """Process what has come since the last call; all alerts so far."""
        # timers need this store; each of its partitions has a cost of its own in every batch. A query takes
        # both settings at its start, and the number of partitions from its checkpoint later on
        most = 2 * self.spark.sparkContext.defaultParallelism
        settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS,
                    "spark.sql.shuffle.partitions": str(min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), most))}
        before = {key: self.spark.conf.get(key, None) for key in settings}
        for key, value in settings.items():
            self.spark.conf.set(key, value)
        try:
            query = (self.alerts.writeStream.format("parquet").outputMode("append")
                     .option("checkpointLocation", self.path + "-checkpoint").trigger(availableNow=True).start(self.path))
            query.awaitTermination()
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        return self.spark.read.schema(OUTPUT).parquet(self.path)

    def beat(self, at) -> None:
        """Tell the watch that it is ``at`` (a column or text) now: later silence is counted from here."""
        moment = at if hasattr(at, "alias") else F.lit(at)
        self.spark.range(1).select(moment.cast("timestamp").alias(TS)).write.mode("append").parquet(self.beats)
