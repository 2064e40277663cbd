"""Registration, output form and the shared SQL of the given tables.

Both sides emit only BIGINT, DOUBLE and VARCHAR: dates and times as text, flags as 0/1,
doubles rounded by the same arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import DataFrame, types as T

DIGITS = 6
# Rounds up from .5013 on. Readings are decimals, so means fall on exact halves of the last
# digit; off the half, the order of a summation cannot decide the result.
ROUND_UP = 0.4987


@dataclass
class Query:
    run: Callable
    sql: str | None


def present(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Bring a result into the output form."""
    scale = f"{10 ** digits}D"
    out = []
    for f in df.schema.fields:
        c, kind = f"`{f.name}`", f.dataType
        if isinstance(kind, T.DateType):
            text = f"date_format({c}, 'yyyy-MM-dd')"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            text = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')"
        elif isinstance(kind, T.BooleanType):
            text = f"CAST(CAST({c} AS INT) AS BIGINT)"
        elif isinstance(kind, T.IntegralType):
            text = f"CAST({c} AS BIGINT)"
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            value = f"CAST({c} AS DOUBLE)"
            text = (f"CASE WHEN NOT isnan({value}) THEN "
                    f"CAST(floor({value} * {scale} + {ROUND_UP}D) AS DOUBLE) / {scale} END")
        else:
            text = c
        out.append(f"{text} AS {c}")
    return df.selectExpr(*out)


def shape(sql: str, columns: str, digits: int = DIGITS) -> str:
    """The same form in SQL. ``columns`` lists ``name:kind`` with kind d(ate), t(ime),
    f(loat), i(nteger), s(tring)."""
    scale = f"1e{digits}"
    out = []
    for item in columns.split():
        name, kind = item.rsplit(":", 1)
        text = {
            "d": f"strftime({name}, '%Y-%m-%d')",
            "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
            "i": f"CAST({name} AS BIGINT)",
            "s": f"CAST({name} AS VARCHAR)",
            "f": (f"CASE WHEN isnan(CAST({name} AS DOUBLE)) OR isinf(CAST({name} AS DOUBLE)) "
                  f"THEN NULL ELSE floor(CAST({name} AS DOUBLE) * {scale} + {ROUND_UP}) / {scale} END"),
        }[kind]
        out.append(f"{text} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) shaped"


def catalog():
    """A registry and the decorator that fills it."""
    entries: dict[str, Query] = {}

    def query(name, sql=None, columns=None, digits=DIGITS):
        text = shape(sql, columns, digits) if sql and columns else sql

        def register(fn):
            entries[name] = Query(lambda spark, sf_dir: present(fn(spark, sf_dir), digits), text)
            return fn
        return register
    return entries, query


ENERGY_F = "production_kwh:f consumption_kwh:f export_kwh:f import_kwh:f"
ENERGY = ("production_kwh", "consumption_kwh", "export_kwh", "import_kwh")

# The adapters in SQL.
RAW_DAILY = """raw_daily AS (
  SELECT site_id, day, p AS production_kwh, c AS consumption_kwh, x AS export_kwh,
         greatest(c - (p - x), 0.0) AS import_kwh
  FROM (SELECT l_suppkey // 10 AS site_id, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS p,
               sum(floor(l_extendedprice / 125) / 8.0) AS c,
               sum(l_quantity * round(l_discount * 100) / 32) AS x
        FROM lineitem GROUP BY 1, 2) t)"""
SPINE = """spine AS (
  SELECT site_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT site_id, CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi
        FROM raw_daily GROUP BY 1) b)"""
DAILY = RAW_DAILY + ",\n" + SPINE + """,
daily AS (
  SELECT s.site_id, s.day, coalesce(r.production_kwh, 0) AS production_kwh,
         coalesce(r.consumption_kwh, 0) AS consumption_kwh, coalesce(r.export_kwh, 0) AS export_kwh,
         coalesce(r.import_kwh, 0) AS import_kwh
  FROM spine s LEFT JOIN raw_daily r USING (site_id, day))"""
API = """api AS (
  SELECT o_custkey // 150 AS site_id, CAST(o_orderdate AS DATE) AS day,
         sum(floor(o_totalprice / 1250) / 8.0) AS production_kwh
  FROM orders GROUP BY 1, 2)"""
SLOT = "make_timestamp(CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) * 1000000)"
INTERVALS_WH = f"""intervals_wh AS (
  SELECT user_id // 15 AS site_id, {SLOT} AS ts,
         sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END) / 100.0 AS production_wh,
         sum(CASE WHEN event_type = 'click' THEN CAST(round(value * 100) AS BIGINT) END) / 100.0 AS consumption_wh,
         sum(CASE WHEN event_type = 'signup' THEN CAST(round(value * 100) AS BIGINT) END) / 100.0 AS export_wh,
         sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) END) / 100.0 AS import_wh,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS faults
  FROM events GROUP BY 1, 2)"""
INTERVALS = INTERVALS_WH + """,
intervals AS (
  SELECT site_id, ts, production_wh / 1000.0 AS production_kwh, consumption_wh / 1000.0 AS consumption_kwh,
         export_wh / 1000.0 AS export_kwh, import_wh / 1000.0 AS import_kwh FROM intervals_wh)"""
READINGS = f"""readings AS (
  SELECT user_id // 15 AS site_id, {SLOT} AS ts,
         CASE WHEN event_type = 'purchase' THEN round(value * 100) / 100000.0 END AS production_kwh,
         CASE WHEN event_type = 'click' THEN round(value * 100) / 100000.0 END AS consumption_kwh,
         CASE WHEN event_type = 'signup' THEN round(value * 100) / 100000.0 END AS export_kwh,
         CASE WHEN event_type = 'view' THEN round(value * 100) / 100000.0 END AS import_kwh
  FROM events)"""
WX_DAILY = """wx_daily AS (
  SELECT site_id, day, CAST(c % 13 AS DOUBLE) AS sunshine_hours,
         CAST(c % 101 AS DOUBLE) AS cloudcover_mean_pct, CAST(k % 41 - 5 AS DOUBLE) AS temp_mean_c,
         CAST(k % 41 - 5 + k % 8 AS DOUBLE) AS temp_max_c, CAST(k % 41 - 5 - c % 8 AS DOUBLE) AS temp_min_c,
         CAST(k % 7 AS DOUBLE) AS precipitation_mm, CAST(k % 31 AS DOUBLE) AS solar_radiation_mj
  FROM (SELECT o_custkey // 150 AS site_id, CAST(o_orderdate AS DATE) AS day,
               min(o_orderkey) AS k, arg_min(o_custkey, o_orderkey) AS c
        FROM orders GROUP BY 1, 2) t)"""
WX_HOURLY = """wx_hourly AS (
  SELECT site_id, ts, CAST(k % 41 - 5 AS DOUBLE) AS temperature, CAST(20 + k % 71 AS DOUBLE) AS humidity,
         CAST((k * 7) % 101 AS DOUBLE) AS cloud_cover, CAST(1 + k % 10 AS DOUBLE) AS visibility,
         CAST(k % 16 AS DOUBLE) AS wind_speed, CAST((k * 13) % 360 AS DOUBLE) AS wind_direction,
         CAST(990 + k % 51 AS DOUBLE) AS pressure, CAST((k * 11) % 1001 AS DOUBLE) AS ghi,
         CAST((k * 17) % 801 AS DOUBLE) AS dni, CAST((k * 5) % 301 AS DOUBLE) AS dhi,
         CAST(k % 12 AS DOUBLE) AS uv_index
  FROM (SELECT user_id // 15 AS site_id, date_trunc('hour', ts) AS ts, min(event_id) AS k
        FROM events GROUP BY 1, 2) t)"""
MERGED = INTERVALS + ",\n" + WX_HOURLY + """,
merged AS (
  SELECT p.site_id, p.ts, p.production_kwh, p.consumption_kwh, p.export_kwh, p.import_kwh,
         w.temperature, w.humidity, w.cloud_cover, w.visibility, w.wind_speed, w.wind_direction,
         w.pressure, w.ghi, w.dni, w.dhi, w.uv_index
  FROM (SELECT site_id, date_trunc('hour', ts) AS ts, avg(production_kwh) AS production_kwh,
               avg(consumption_kwh) AS consumption_kwh, avg(export_kwh) AS export_kwh,
               avg(import_kwh) AS import_kwh FROM intervals GROUP BY 1, 2) p
  JOIN wx_hourly w USING (site_id, ts))"""
WX_HOURLY_F = ("temperature:f humidity:f cloud_cover:f visibility:f wind_speed:f wind_direction:f "
               "pressure:f ghi:f dni:f dhi:f uv_index:f")
WX_DAILY_F = ("sunshine_hours:f cloudcover_mean_pct:f temp_mean_c:f temp_max_c:f temp_min_c:f "
              "precipitation_mm:f solar_radiation_mj:f")


def values(name: str, rows, columns: str) -> str:
    """A CTE of literal rows."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(
            v, float) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(*ctes, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
