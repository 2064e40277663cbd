"""Column names and explicit schemas."""

from __future__ import annotations

from pyspark.sql import types as T

SITE, DAY, TS = "site_id", "day", "ts"
PRODUCTION, CONSUMPTION = "production_kwh", "consumption_kwh"
EXPORT, IMPORT = "export_kwh", "import_kwh"
ENERGY = (PRODUCTION, CONSUMPTION, EXPORT, IMPORT)


def _fields(names, kind):
    return [T.StructField(n, kind) for n in names]


INTERVAL_SCHEMA = T.StructType(
    [T.StructField(SITE, T.LongType()), T.StructField(TS, T.TimestampType())]
    + _fields(ENERGY, T.DoubleType()))

DAILY_SCHEMA = T.StructType(
    [T.StructField(SITE, T.LongType()), T.StructField(DAY, T.DateType())]
    + _fields(ENERGY, T.DoubleType()))

WEATHER_HOURLY = ("temperature", "humidity", "cloud_cover", "visibility", "wind_speed",
                  "wind_direction", "pressure", "ghi", "dni", "dhi", "uv_index")

WEATHER_HOURLY_SCHEMA = T.StructType(
    [T.StructField(SITE, T.LongType()), T.StructField(TS, T.TimestampType())]
    + _fields(WEATHER_HOURLY, T.DoubleType()))

WEATHER_DAILY = ("sunshine_hours", "cloudcover_mean_pct", "temp_mean_c", "temp_max_c",
                 "temp_min_c", "precipitation_mm", "solar_radiation_mj")

WEATHER_DAILY_SCHEMA = T.StructType(
    [T.StructField(SITE, T.LongType()), T.StructField(DAY, T.DateType())]
    + _fields(WEATHER_DAILY, T.DoubleType()))

# Vendor payloads: field names are fixed by the feeds.
LIFETIME_PAYLOAD = "start_date STRING, meter_start_date STRING, production ARRAY<DOUBLE>"

REVENUE_METER_PAYLOAD = (
    "meter_intervals ARRAY<STRUCT<meter_serial_number: STRING, envoy_serial_number: STRING,"
    " intervals: ARRAY<STRUCT<channel: BIGINT, end_at: BIGINT, wh_del: DOUBLE, curr_w: DOUBLE>>>>")

TELEMETRY_PAYLOAD = (
    "intervals ARRAY<STRUCT<end_at: BIGINT, wh_del: DOUBLE, devices_reporting: DOUBLE>>")

HOURLY_WEATHER_PAYLOAD = (
    "hourly STRUCT<`time`: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>,"
    " relative_humidity_2m: ARRAY<DOUBLE>, cloud_cover: ARRAY<DOUBLE>, visibility: ARRAY<DOUBLE>,"
    " wind_speed_10m: ARRAY<DOUBLE>, wind_direction_10m: ARRAY<DOUBLE>,"
    " surface_pressure: ARRAY<DOUBLE>, shortwave_radiation: ARRAY<DOUBLE>,"
    " direct_radiation: ARRAY<DOUBLE>, diffuse_radiation: ARRAY<DOUBLE>, uv_index: ARRAY<DOUBLE>>")

ONE_CALL_WEATHER_PAYLOAD = (
    "hourly ARRAY<STRUCT<dt: BIGINT, temp: DOUBLE, humidity: DOUBLE, clouds: DOUBLE,"
    " visibility: DOUBLE, wind_speed: DOUBLE, wind_deg: DOUBLE, pressure: DOUBLE, uvi: DOUBLE>>")

IRRADIANCE_PAYLOAD = (
    "hourly STRUCT<`time`: ARRAY<STRING>, shortwave_radiation: ARRAY<DOUBLE>,"
    " direct_radiation: ARRAY<DOUBLE>, diffuse_radiation: ARRAY<DOUBLE>,"
    " direct_normal_irradiance: ARRAY<DOUBLE>, global_tilted_irradiance: ARRAY<DOUBLE>,"
    " cloud_cover: ARRAY<DOUBLE>, temperature_2m: ARRAY<DOUBLE>>")
