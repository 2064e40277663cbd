"""Landed vendor payloads (one JSON document per row) to flat rows.

Input: ``site_id`` and a text column with the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..schema import DAY, SITE, TS


def _decode(raw: DataFrame, payload: str, column: str) -> DataFrame:
    return raw.select(SITE, F.from_json(F.col(column), payload).alias("doc"))


def parse_energy_lifetime(raw: DataFrame, column="payload") -> DataFrame:
    """The position in ``production`` counts days from ``start_date``."""
    wh = F.col("wh")
    return (_decode(raw, S.LIFETIME_PAYLOAD, column)
            .select(SITE, F.to_date("doc.start_date").alias("start"),
                    F.posexplode("doc.production").alias("pos", "wh"))
            .where(F.col("start").isNotNull())
            .select(SITE, F.date_add("start", F.col("pos")).alias(DAY),
                    wh.alias("daily_energy_wh"),
                    F.when(wh > 0, wh / F.lit(1000.0)).otherwise(F.lit(0.0))
                    .alias("daily_energy_kwh")))


def parse_rgm_stats(raw: DataFrame, column="payload") -> DataFrame:
    """Revenue-grade meter: meters x intervals; missing readings count as 0."""
    wh, watt = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("i.wh_del", "i.curr_w"))
    return (_decode(raw, S.REVENUE_METER_PAYLOAD, column)
            .select(SITE, F.explode("doc.meter_intervals").alias("m"))
            .select(SITE,
                    F.coalesce("m.meter_serial_number", F.lit("unknown")).alias("meter_serial"),
                    F.coalesce("m.envoy_serial_number", F.lit("unknown")).alias("gateway_serial"),
                    F.explode("m.intervals").alias("i"))
            .select(SITE, F.timestamp_seconds("i.end_at").alias(TS),
                    F.coalesce("i.channel", F.lit(1)).cast("bigint").alias("channel"),
                    wh.alias("energy_delivered_wh"),
                    (wh / F.lit(1000.0)).alias("energy_delivered_kwh"),
                    watt.alias("current_power_w"),
                    (watt / F.lit(1000.0)).alias("current_power_kw"),
                    "meter_serial", "gateway_serial"))


def parse_meter_telemetry(raw: DataFrame, column="payload") -> DataFrame:
    """Quarter-hour production telemetry; absent numbers count as 0."""
    wh = F.coalesce(F.col("i.wh_del"), F.lit(0.0))
    return (_decode(raw, S.TELEMETRY_PAYLOAD, column)
            .select(SITE, F.explode("doc.intervals").alias("i"))
            .select(SITE, F.timestamp_seconds("i.end_at").alias(TS), wh.alias("production_wh"),
                    (wh / F.lit(1000.0)).alias("production_kwh"),
                    F.coalesce("i.devices_reporting", F.lit(0.0)).alias("devices_reporting")))


def telemetry_daily(df: DataFrame) -> DataFrame:
    return (df.groupBy(SITE, F.to_date(TS).alias(DAY))
            .agg(F.sum("production_wh").alias("production_wh"),
                 F.sum("production_kwh").alias("production_kwh"),
                 F.avg("devices_reporting").alias("devices_reporting")))


def _zip_hourly(raw, payload, column, fields):
    # an absent series is padded with NULL instead of voiding the whole document
    empty = F.array().cast("array<double>")
    series = [F.coalesce(F.col(f"doc.hourly.{f}"), empty).alias(f) for f in fields]
    zipped = F.arrays_zip(F.col("doc.hourly.time").alias("time"), *series)
    return (_decode(raw, payload, column)
            .select(SITE, F.explode(zipped).alias("h"))
            .select(SITE, F.to_timestamp(F.replace(F.col("h.time"), F.lit("T"), F.lit(" ")))
                    .alias(TS), *[F.col(f"h.{f}").alias(f) for f in fields]))


def _or(c, default):
    return F.coalesce(F.col(c), F.lit(float(default)))


def _truthy_or(c, default):
    """Zero takes the default too, as an absent value does."""
    value = F.col(c)
    return F.when(value != 0, value).otherwise(F.lit(float(default)))


def parse_weather_hourly(raw: DataFrame, column="payload", historical=False) -> DataFrame:
    """Parallel arrays of an hourly forecast, or of the archive (no visibility, no UV)."""
    fields = ("temperature_2m", "relative_humidity_2m", "cloud_cover", "visibility",
              "wind_speed_10m", "wind_direction_10m", "surface_pressure", "shortwave_radiation",
              "direct_radiation", "diffuse_radiation", "uv_index")
    flat = _zip_hourly(raw, S.HOURLY_WEATHER_PAYLOAD, column, fields)
    visibility = (F.lit(10.0) if historical else
                  F.when(F.col("visibility") != 0, F.col("visibility") / F.lit(1000.0))
                  .otherwise(F.lit(10.0)))
    uv = F.lit(None).cast("double") if historical else _or("uv_index", 0)
    return flat.select(
        SITE, TS, _or("temperature_2m", 0).alias("temperature"),
        _or("relative_humidity_2m", 0).alias("humidity"),
        _or("cloud_cover", 0).alias("cloud_cover"), visibility.alias("visibility"),
        _or("wind_speed_10m", 0).alias("wind_speed"),
        _or("wind_direction_10m", 0).alias("wind_direction"),
        _truthy_or("surface_pressure", 1013).alias("pressure"),
        F.col("shortwave_radiation").alias("ghi"), F.col("direct_radiation").alias("dni"),
        F.col("diffuse_radiation").alias("dhi"), uv.alias("uv_index"))


def parse_weather_onecall(raw: DataFrame, column="payload") -> DataFrame:
    """The other forecast vendor: one object per hour, no irradiance."""
    none = F.lit(None).cast("double")
    return (_decode(raw, S.ONE_CALL_WEATHER_PAYLOAD, column)
            .select(SITE, F.explode("doc.hourly").alias("h"))
            .select(SITE, F.timestamp_seconds("h.dt").alias(TS), F.col("h.temp").alias("temperature"),
                    F.col("h.humidity").alias("humidity"), F.col("h.clouds").alias("cloud_cover"),
                    (_or("h.visibility", 10000) / F.lit(1000.0)).alias("visibility"),
                    F.col("h.wind_speed").alias("wind_speed"),
                    _or("h.wind_deg", 0).alias("wind_direction"),
                    F.col("h.pressure").alias("pressure"), none.alias("ghi"), none.alias("dni"),
                    none.alias("dhi"), _or("h.uvi", 0).alias("uv_index")))


# Vendor names of irradiance series and their standard names.
IRRADIANCE_NAMES = {"shortwave_radiation": "ghi", "direct_radiation": "dni",
                    "diffuse_radiation": "dhi", "direct_normal_irradiance": "dni_normal",
                    "global_tilted_irradiance": "gti"}


def parse_irradiance_hourly(raw: DataFrame, column="payload") -> DataFrame:
    fields = (*IRRADIANCE_NAMES, "cloud_cover", "temperature_2m")
    return (_zip_hourly(raw, S.IRRADIANCE_PAYLOAD, column, fields)
            .withColumnsRenamed(IRRADIANCE_NAMES))
