"""Readers, payload parsers and writers. Files and payloads are rebuilt from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.rollup import fill_days
from ..session import work_path
from .. import schema as S
from ..sources import adapters as A, clustered, columns, files, payloads, quarantine
from .base import (API, DAILY, ENERGY, ENERGY_F, INTERVALS, INTERVALS_WH, RAW_DAILY, WX_HOURLY,
                   catalog, with_)

CATALOG, query = catalog()

VENDOR = {"ts": "Date/Time", "production_wh": "Energy Produced (Wh)",
          "consumption_wh": "Energy Consumed (Wh)", "export_wh": "Exported to Grid (Wh)",
          "import_wh": "Imported from Grid (Wh)"}


def vendor_frame(spark, sf_dir) -> DataFrame:
    df = A.intervals_wh(spark, sf_dir).drop("faults")
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumnsRenamed(VENDOR)


def landed_csv(spark, sf_dir) -> str:
    path = work_path(spark, "meter-export")
    vendor_frame(spark, sf_dir).write.option("header", True).csv(path)
    return path


@query("a1_read_interval_csv",
       with_(INTERVALS_WH, select="SELECT site_id, ts, production_wh, consumption_wh, export_wh, import_wh FROM intervals_wh"),
       "site_id:i ts:t production_wh:f consumption_wh:f export_wh:f import_wh:f")
def a1(spark, sf_dir):
    df = files.read_interval_csv(spark, landed_csv(spark, sf_dir))
    return df.withColumnsRenamed({v: k for k, v in VENDOR.items() if k != "ts"})


@query("a2_wh_to_kwh", with_(INTERVALS, select="SELECT * FROM intervals"), f"site_id:i ts:t {ENERGY_F}")
def a2(spark, sf_dir):
    return files.wh_to_kwh(A.intervals_wh(spark, sf_dir).drop("faults"))


A3_SQL = with_(INTERVALS, RAW_DAILY, select="""
SELECT site_id, ts, production_kwh, consumption_kwh, export_kwh, import_kwh FROM intervals
UNION ALL
SELECT site_id, CAST(day AS TIMESTAMP), production_kwh, consumption_kwh, export_kwh, NULL FROM raw_daily""")


@query("a3_harmonise_feeds", A3_SQL, f"site_id:i ts:t {ENERGY_F}")
def a3(spark, sf_dir):
    first = A.intervals(spark, sf_dir).withColumnsRenamed({
        "ts": "Reading Time", "production_kwh": "Energy Produced (kWh)",
        "consumption_kwh": "Energy Consumed (kWh)", "export_kwh": "Exported (kWh)",
        "import_kwh": "Imported (kWh)"})
    second = A.daily_raw(spark, sf_dir).select(
        "site_id", F.col("day").cast("timestamp").alias("timestamp"),
        F.col("production_kwh").alias("erzeugung"), F.col("consumption_kwh").alias("verbrauch"),
        F.col("export_kwh").alias("feed_in"))
    return columns.union_feeds([first, second])


@query("a4_validate_feed", with_(INTERVALS_WH, select="""
SELECT 'meter' AS feed, 'VALID' AS status, role, column_name AS "column", 1 AS detected, non_null, rows_ AS rows
FROM (SELECT count(*) AS rows_, count(production_wh) AS p, count(consumption_wh) AS c,
             count(export_wh) AS x, count(import_wh) AS i, count(ts) AS t FROM intervals_wh) n,
LATERAL (VALUES ('production', 'Energy Produced (Wh)', p), ('consumption', 'Energy Consumed (Wh)', c),
  ('export', 'Exported to Grid (Wh)', x), ('import', 'Imported from Grid (Wh)', i),
  ('datetime', 'Date/Time', t)) v(role, column_name, non_null)"""),
    'feed:s status:s role:s "column":s detected:i non_null:i rows:i')
def a4(spark, sf_dir):
    return columns.validate_feed(vendor_frame(spark, sf_dir), "meter")


def lifetime_payloads(spark, sf_dir) -> DataFrame:
    """One document per site and year: contiguous days from the first one."""
    days = fill_days(A.api_daily(spark, sf_dir), ["production_kwh"])
    docs = days.groupBy("site_id", F.year("day").alias("y")).agg(
        F.min("day").alias("start"),
        F.array_sort(F.collect_list(F.struct("day", (F.col("production_kwh") * 1000).alias("wh"))))
        .alias("d"))
    return docs.select("site_id", F.to_json(F.struct(
        F.date_format("start", "yyyy-MM-dd").alias("start_date"), F.col("d.wh").alias("production")))
        .alias("payload"))


A5_SQL = with_(API, select="""
SELECT s.site_id, s.day, coalesce(a.production_kwh, 0) * 1000 AS daily_energy_wh,
       coalesce(a.production_kwh, 0) AS daily_energy_kwh
FROM (SELECT site_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP),
             INTERVAL 1 DAY)) AS DATE) AS day FROM api GROUP BY 1) s LEFT JOIN api a USING (site_id, day)""")


@query("a5_energy_lifetime", A5_SQL, "site_id:i day:d daily_energy_wh:f daily_energy_kwh:f")
def a5(spark, sf_dir):
    return payloads.parse_energy_lifetime(lifetime_payloads(spark, sf_dir))


def meter_payloads(spark, sf_dir) -> DataFrame:
    """One revenue-meter document per site and day: a production and a consumption meter."""
    df = A.intervals_wh(spark, sf_dir)

    def reading(channel, wh):
        return F.struct(F.lit(channel).cast("bigint").alias("channel"),
                        F.unix_seconds("ts").alias("end_at"), F.col(wh).alias("wh_del"),
                        (F.col(wh) * 4).alias("curr_w"))

    docs = df.groupBy("site_id", F.to_date("ts").alias("day")).agg(
        F.collect_list(reading(1, "production_wh")).alias("a"),
        F.collect_list(reading(2, "consumption_wh")).alias("b"))
    meters = F.array(*[F.struct(F.lit(f"m{n}").alias("meter_serial_number"),
                                F.col("site_id").cast("string").alias("envoy_serial_number"),
                                F.col(c).alias("intervals")) for n, c in ((1, "a"), (2, "b"))])
    return docs.select("site_id", F.to_json(F.struct(meters.alias("meter_intervals")))
                       .alias("payload"))


def meter(spark, sf_dir) -> DataFrame:
    return payloads.parse_rgm_stats(meter_payloads(spark, sf_dir))


METER = """meter AS (
  SELECT site_id, ts, 1 AS channel, coalesce(production_wh, 0) AS wh FROM intervals_wh
  UNION ALL SELECT site_id, ts, 2, coalesce(consumption_wh, 0) FROM intervals_wh)"""


@query("a6_revenue_meter", with_(INTERVALS_WH, METER, select="""
SELECT site_id, ts, channel, wh AS energy_delivered_wh, wh / 1000.0 AS energy_delivered_kwh,
       wh * 4 AS current_power_w, wh * 4 / 1000.0 AS current_power_kw, 'm' || channel AS meter_serial,
       CAST(site_id AS VARCHAR) AS gateway_serial FROM meter"""),
    "site_id:i ts:t channel:i energy_delivered_wh:f energy_delivered_kwh:f current_power_w:f "
    "current_power_kw:f meter_serial:s gateway_serial:s")
def a6(spark, sf_dir):
    return meter(spark, sf_dir)


def telemetry_payloads(spark, sf_dir) -> DataFrame:
    reading = F.struct(F.unix_seconds("ts").alias("end_at"), F.col("production_wh").alias("wh_del"),
                       F.col("faults").cast("double").alias("devices_reporting"))
    docs = A.intervals_wh(spark, sf_dir).groupBy("site_id", F.to_date("ts").alias("day")).agg(
        F.collect_list(reading).alias("intervals"))
    return docs.select("site_id", F.to_json(F.struct("intervals")).alias("payload"))


def telemetry(spark, sf_dir):
    return payloads.parse_meter_telemetry(telemetry_payloads(spark, sf_dir))


@query("a7_meter_telemetry", with_(INTERVALS_WH, select="""
SELECT site_id, ts, coalesce(production_wh, 0) AS production_wh, coalesce(production_wh, 0) / 1000.0 AS production_kwh,
       faults AS devices_reporting FROM intervals_wh"""),
    "site_id:i ts:t production_wh:f production_kwh:f devices_reporting:f")
def a7(spark, sf_dir):
    return telemetry(spark, sf_dir)


@query("a8_telemetry_daily", with_(INTERVALS_WH, select="""
SELECT site_id, CAST(ts AS DATE) AS day, sum(coalesce(production_wh, 0)) AS production_wh,
       sum(coalesce(production_wh, 0) / 1000.0) AS production_kwh, avg(faults) AS devices_reporting
FROM intervals_wh GROUP BY 1, 2"""),
    "site_id:i day:d production_wh:f production_kwh:f devices_reporting:f")
def a8(spark, sf_dir):
    return payloads.telemetry_daily(telemetry(spark, sf_dir))


def _weather_docs(spark, sf_dir, fields):
    """Parallel arrays per site and day. ``fields`` maps payload names to SQL text."""
    wx = A.weather_hourly(spark, sf_dir)
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
                   *[F.expr(e).alias(n) for n, e in fields.items()])
    docs = wx.groupBy("site_id", F.to_date("ts").alias("day")).agg(F.collect_list(row).alias("h"))
    hourly = F.struct(*[F.col(f"h.{n}").alias(n) for n in ("time", *fields)])
    return docs.select("site_id", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))


FORECAST_FIELDS = {
    "temperature_2m": "nullif(temperature, 0D)", "relative_humidity_2m": "humidity",
    "cloud_cover": "nullif(cloud_cover, 7D)", "visibility": "(visibility - 1) * 1000",
    "wind_speed_10m": "wind_speed", "wind_direction_10m": "wind_direction",
    "surface_pressure": "nullif(pressure, 1000D)", "shortwave_radiation": "nullif(ghi, 0D)",
    "direct_radiation": "dni", "diffuse_radiation": "dhi", "uv_index": "uv_index"}
FORECAST_SQL = """SELECT site_id, ts, temperature, humidity,
  CASE WHEN cloud_cover = 7 THEN 0 ELSE cloud_cover END AS cloud_cover,
  {visibility} AS visibility, wind_speed, wind_direction,
  CASE WHEN pressure = 1000 THEN 1013 ELSE pressure END AS pressure, nullif(ghi, 0) AS ghi, dni, dhi,
  {uv} AS uv_index FROM wx_hourly"""
WX_KINDS = ("site_id:i ts:t temperature:f humidity:f cloud_cover:f visibility:f wind_speed:f "
            "wind_direction:f pressure:f ghi:f dni:f dhi:f uv_index:f")


@query("a9_weather_forecast", with_(WX_HOURLY, select=FORECAST_SQL.format(
    visibility="CASE WHEN visibility = 1 THEN 10.0 ELSE visibility - 1 END", uv="uv_index")), WX_KINDS)
def a9(spark, sf_dir):
    return payloads.parse_weather_hourly(_weather_docs(spark, sf_dir, FORECAST_FIELDS))


@query("a9_weather_archive", with_(WX_HOURLY, select=FORECAST_SQL.format(
    visibility="10.0", uv="CAST(NULL AS DOUBLE)")), WX_KINDS)
def a9_archive(spark, sf_dir):
    fields = {k: v for k, v in FORECAST_FIELDS.items() if k not in ("visibility", "uv_index")}
    return payloads.parse_weather_hourly(_weather_docs(spark, sf_dir, fields), historical=True)


@query("a9_weather_onecall", with_(WX_HOURLY, select="""
SELECT site_id, ts, temperature, humidity, cloud_cover,
       CASE WHEN visibility = 5 THEN 10.0 ELSE visibility END AS visibility, wind_speed, wind_direction,
       pressure, CAST(NULL AS DOUBLE) AS ghi, CAST(NULL AS DOUBLE) AS dni, CAST(NULL AS DOUBLE) AS dhi,
       uv_index FROM wx_hourly"""), WX_KINDS)
def a9_onecall(spark, sf_dir):
    row = F.struct(F.unix_seconds("ts").alias("dt"), F.col("temperature").alias("temp"), "humidity",
                   F.col("cloud_cover").alias("clouds"),
                   F.expr("nullif(visibility, 5D) * 1000").alias("visibility"), "wind_speed",
                   F.col("wind_direction").alias("wind_deg"), "pressure",
                   F.col("uv_index").alias("uvi"))
    docs = A.weather_hourly(spark, sf_dir).groupBy("site_id", F.to_date("ts").alias("day")).agg(
        F.collect_list(row).alias("hourly"))
    return payloads.parse_weather_onecall(
        docs.select("site_id", F.to_json(F.struct("hourly")).alias("payload")))


@query("a10_irradiance", with_(WX_HOURLY, select="""
SELECT site_id, ts, ghi, dni, dhi, dni + dhi AS dni_normal, ghi / 2 AS gti, cloud_cover,
       temperature AS temperature_2m FROM wx_hourly"""),
    "site_id:i ts:t ghi:f dni:f dhi:f dni_normal:f gti:f cloud_cover:f temperature_2m:f")
def a10(spark, sf_dir):
    fields = {"shortwave_radiation": "ghi", "direct_radiation": "dni", "diffuse_radiation": "dhi",
              "direct_normal_irradiance": "dni + dhi", "global_tilted_irradiance": "ghi / 2",
              "cloud_cover": "cloud_cover", "temperature_2m": "temperature"}
    return payloads.parse_irradiance_hourly(_weather_docs(spark, sf_dir, fields))


@query("a11_write_dataset", with_(DAILY, select="SELECT *, year(day) AS year FROM daily"),
       f"site_id:i day:d year:i {ENERGY_F}")
def a11(spark, sf_dir):
    days = fill_days(A.daily_raw(spark, sf_dir))
    path = files.write_dataset(days, work_path(spark, "daily"))
    return spark.read.parquet(path).select("site_id", "day", "year", *ENERGY)


@query("a11_write_csv", with_(DAILY, select="SELECT * FROM daily"), f"site_id:i day:d {ENERGY_F}")
def a11_csv(spark, sf_dir):
    days = fill_days(A.daily_raw(spark, sf_dir))
    path = files.write_dataset(days, work_path(spark, "daily-csv"), "csv")
    return spark.read.option("header", True).schema(
        "site_id BIGINT, day DATE, " + ", ".join(f"{c} DOUBLE" for c in ENERGY)).csv(path).select(
        "site_id", "day", *ENERGY)


@query("a12_read_parquet", "SELECT event_id, ts, user_id, event_type, value FROM events",
       "event_id:i ts:t user_id:i event_type:s value:f")
def a12(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


# which row of the export is spoilt, and how, by the number of its quarter hour
SPOILT = "CAST(floor(epoch(ts) / 900) AS BIGINT) % 10"


def spoilt_csv(spark, sf_dir) -> str:
    """The meter export as lines: in ten quarter hours, one lacks fields, one has no time, one a word for a number."""
    kind = F.floor(F.unix_seconds("ts") / 900) % 10
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in VENDOR if c != "ts"}
    stamp = F.when(kind == 2, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    first = F.when(kind == 3, "much").otherwise(text["production_wh"])
    whole = F.concat_ws(",", F.col("site_id").cast("string"), stamp, first, *list(text.values())[1:])
    line = F.when(kind == 1, F.concat_ws(",", F.col("site_id").cast("string"), stamp)).otherwise(whole)
    path = work_path(spark, "spoilt-export")
    A.intervals_wh(spark, sf_dir).select(line.alias("value")).write.text(path)
    return path


def checked_csv(spark, sf_dir):
    return quarantine.read_csv_checked(spark, spoilt_csv(spark, sf_dir), ["site_id", *VENDOR], ts_col="ts", header=False)


@query("a1_quarantine_good", with_(INTERVALS_WH, select=f"""
SELECT site_id, ts, production_wh, consumption_wh, export_wh, import_wh FROM intervals_wh WHERE {SPOILT} NOT IN (1, 2, 3)"""),
    "site_id:i ts:t production_wh:f consumption_wh:f export_wh:f import_wh:f")
def a1_good(spark, sf_dir):
    return quarantine.good(checked_csv(spark, sf_dir))


@query("a1_quarantine_bad", with_(INTERVALS_WH, f"""b AS (SELECT *, {SPOILT} AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM intervals_wh)""", select="""
SELECT site_id, CASE kind WHEN 1 THEN 'fields' WHEN 2 THEN 'time' ELSE 'number:production_wh' END AS problem, count(*) AS n,
  min(CASE kind WHEN 1 THEN site_id || ',' || t END) AS first_line FROM b WHERE kind IN (1, 2, 3) GROUP BY 1, 2"""),
    "site_id:i problem:s n:i first_line:s")
def a1_bad(spark, sf_dir):
    told = quarantine.bad(checked_csv(spark, sf_dir)).withColumn(
        "site_id", F.coalesce("site_id", F.regexp_extract("line", r"^(\d+),", 1).cast("bigint")))
    return told.groupBy("site_id", "problem").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("problem") == "fields", F.col("line"))).alias("first_line"))


@query("a7_quarantined_payloads", with_(INTERVALS_WH, select="""
SELECT site_id, CASE WHEN day(d) % 5 = 1 THEN 'json' ELSE 'missing:intervals' END AS problem, count(*) AS n
FROM (SELECT DISTINCT site_id, CAST(ts AS DATE) AS d FROM intervals_wh) x WHERE day(d) % 5 IN (1, 2) GROUP BY 1, 2"""), "site_id:i problem:s n:i")
def a7_checked(spark, sf_dir):
    """Documents of every fifth day are cut off, and of the day after have no readings."""
    reading = F.struct(F.unix_seconds("ts").alias("end_at"), F.col("production_wh").alias("wh_del"),
                       F.col("faults").cast("double").alias("devices_reporting"))
    docs = A.intervals_wh(spark, sf_dir).groupBy("site_id", F.to_date("ts").alias("day")).agg(F.collect_list(reading).alias("intervals"))
    text = F.to_json(F.struct("intervals"))
    kind = F.day("day") % 5
    raw = docs.select("site_id", F.when(kind == 1, F.expr("substring(to_json(struct(intervals)), 1, 20)")).when(kind == 2, "{}").otherwise(text).alias("payload"))
    return quarantine.bad(quarantine.check_payloads(raw, S.TELEMETRY_PAYLOAD, ["intervals"])).groupBy("site_id", "problem").agg(
        F.count(F.lit(1)).alias("n"))


@query("a11_clustered_windows", with_(DAILY, select="""
SELECT site_id, day, production_kwh, lag(production_kwh) OVER (PARTITION BY site_id ORDER BY day) AS day_before FROM daily"""),
    "site_id:i day:d production_kwh:f day_before:f")
def a11_clustered(spark, sf_dir):
    """A window per site over the stored buckets, after the last year has been written again."""
    path = work_path(spark, "clustered")
    table = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    days = fill_days(A.daily_raw(spark, sf_dir))
    clustered.write_clustered(days, table, path, 8)
    clustered.write_clustered(days.where("day >= DATE '1998-01-01'"), table, path, 8)
    site = Window.partitionBy("site_id").orderBy("day")
    return clustered.read_clustered(spark, table).select(
        "site_id", "day", "production_kwh", F.lag("production_kwh").over(site).alias("day_before"))
