"""Streaming twins, run over all files that are there, against their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import pin_utc, work_path
from ..sources import adapters as A
from ..streaming import live
from ..streaming.silence import SilenceWatch
from .base import ENERGY_F, READINGS, catalog, with_

CATALOG, query = catalog()


def reading_stream(spark, d):
    """The event log as a stream of single readings (see ``adapters.readings``)."""
    pin_utc(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = live.read_stream(spark, d, schema, pattern="events.parquet")
    kwh, kind = F.floor(F.col("value") * 100 + F.lit(0.5)) / F.lit(100000.0), F.col("event_type")
    return events.select(
        F.expr(f"user_id div {A.USERS_PER_SITE}").alias("site_id"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 900) * 900).alias("ts"),
        *[F.when(kind == k, kwh).alias(f"{n}_kwh") for n, k in A.CHANNELS.items()])


SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in ("production_kwh", "consumption_kwh", "export_kwh", "import_kwh"))


def _rollup(name, period, start, length):
    @query(name, with_(READINGS, select=f"""
SELECT site_id, s AS window_start, s + {length} AS window_end, {SUMS}, count(*) AS readings
FROM (SELECT *, {start} AS s FROM readings) r GROUP BY 1, 2"""),
        f"site_id:i window_start:t window_end:t {ENERGY_F} readings:i")
    def run(spark, d):
        return live.WindowTable(spark, work_path(spark, name), period).run(reading_stream(spark, d))


_rollup("l1_streaming_daily", "1 day", "date_trunc('day', ts)", "INTERVAL 1 DAY")
_rollup("l1_streaming_quarter_hour", "15 minutes", "ts", "INTERVAL 15 MINUTE")


@query("l2_streaming_dedup", with_(READINGS, select="SELECT DISTINCT * FROM readings"), f"site_id:i ts:t {ENERGY_F}")
def l2(spark, d):
    return live.materialise(live.deduplicate(reading_stream(spark, d)), "dedup")


@query("l3_streaming_upsert", with_(READINGS, select="""
SELECT site_id, CAST(ts AS DATE) AS day, coalesce(sum(production_kwh), 0) AS production_kwh FROM readings GROUP BY 1, 2"""),
    "site_id:i day:d production_kwh:f")
def l3(spark, d):
    return live.DailyTable(spark, work_path(spark, "live-daily")).run(reading_stream(spark, d))


@query("l4_rule_alerts", with_(READINGS, f"b AS (SELECT site_id, ts, {SUMS} FROM readings GROUP BY 1, 2)", select="""
SELECT site_id, ts, production_kwh, export_kwh, 'excess_export' AS alert FROM b WHERE export_kwh > production_kwh
UNION ALL SELECT site_id, ts, production_kwh, export_kwh, 'negative_production' FROM b WHERE production_kwh < 0"""),
    "site_id:i ts:t production_kwh:f export_kwh:f alert:s")
def l4(spark, d):
    """A reading has one channel, so the rules look at quarter hours, which have all."""
    slots = live.WindowTable(spark, work_path(spark, "slots"), "15 minutes").run(reading_stream(spark, d))
    return live.rule_alerts(slots.withColumnRenamed("window_start", "ts"))


@query("l4_silence_alerts", with_(READINGS, """o AS (SELECT site_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1350 SECOND THEN 0 ELSE 1 END AS fresh FROM readings
  WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT site_id, min(ts) AS run_start, max(ts) AS last_seen, count(*) AS readings FROM g GROUP BY site_id, run)""", select="""
SELECT *, CAST(epoch(run_start) - epoch(lag(last_seen) OVER (PARTITION BY site_id ORDER BY run_start)) AS BIGINT) AS silent_before_seconds, 'gap' AS alert FROM r"""),
    "site_id:i run_start:t last_seen:t readings:i silent_before_seconds:i alert:s")
def l4_silence(spark, d):
    """All runs: a heartbeat after the end of the log finds every site silent."""
    watch = SilenceWatch(spark, reading_stream(spark, d))
    watch.run()
    end = A.readings(spark, d).agg(F.max("ts")).first()[0]
    watch.beat(F.lit(end) + F.expr("INTERVAL 1 HOUR"))
    return watch.run()
