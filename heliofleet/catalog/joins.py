"""Joins of feeds and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, tariffs
from ..sources import adapters as A, dims
from .base import (API, DAILY, ENERGY_F, MERGED, RAW_DAILY, WX_DAILY, WX_DAILY_F, WX_HOURLY_F, catalog,
                   values, with_)
from .common import daily, merged

CATALOG, query = catalog()
KEY = "site_id:i day:d"
WX_COLS = "w.sunshine_hours, w.cloudcover_mean_pct, w.temp_mean_c, w.temp_max_c, w.temp_min_c, w.precipitation_mm, w.solar_radiation_mj"


@query("c1_merge_weather_hourly", with_(MERGED, select="SELECT * FROM merged"),
       f"site_id:i ts:t {ENERGY_F} {WX_HOURLY_F}")
def c1(spark, d):
    return merged(spark, d)


@query("c1_merge_counts", with_(MERGED, select="""
SELECT site_id, count(*) AS data_points, count(production_kwh) AS usable_rows, min(ts) AS start, max(ts) AS "end"
FROM merged GROUP BY 1"""), 'site_id:i data_points:i usable_rows:i start:t "end":t')
def c1_counts(spark, d):
    return merging.merge_counts(merged(spark, d))


@query("c2_merge_weather_daily", with_(DAILY, WX_DAILY, select=f"""
SELECT d.*, {WX_COLS} FROM daily d LEFT JOIN wx_daily w USING (site_id, day)"""),
    f"{KEY} {ENERGY_F} {WX_DAILY_F}")
def c2(spark, d):
    return merging.merge_weather_daily(daily(spark, d), A.weather_daily(spark, d))


@query("c3_inner_join_on_day", with_(RAW_DAILY, WX_DAILY, select=f"""
SELECT d.*, {WX_COLS} FROM raw_daily d JOIN wx_daily w USING (site_id, day)"""),
    f"{KEY} {ENERGY_F} {WX_DAILY_F}")
def c3(spark, d):
    return merging.merge_weather_daily(A.daily_raw(spark, d), A.weather_daily(spark, d), "inner")


CSV_FIRST = """SELECT site_id, day, production_kwh, consumption_kwh, export_kwh, import_kwh, 'csv' AS source FROM raw_daily
UNION ALL SELECT a.site_id, a.day, a.production_kwh, NULL, NULL, NULL, 'api' FROM api a
  ANTI JOIN raw_daily r ON a.site_id = r.site_id AND a.day = r.day"""
API_FIRST = """SELECT site_id, day, production_kwh, NULL AS consumption_kwh, NULL AS export_kwh, NULL AS import_kwh, 'api' AS source FROM api
UNION ALL SELECT r.site_id, r.day, r.production_kwh, NULL, NULL, NULL, 'csv' FROM raw_daily r
  ANTI JOIN api a ON a.site_id = r.site_id AND a.day = r.day"""
CSV_ONLY = "SELECT *, 'csv' AS source FROM raw_daily"


def _sources(name, sql, priority):
    @query(name, with_(RAW_DAILY, API, select=sql), f"{KEY} {ENERGY_F} source:s")
    def run(spark, d):
        return merging.merge_sources(A.daily_raw(spark, d), A.api_daily(spark, d), priority)


_sources("c4_merge_csv_first", CSV_FIRST, "csv_first")
_sources("c4_merge_api_first", API_FIRST, "api_first")
_sources("c4_merge_csv_only", CSV_ONLY, "csv_only")


@query("c4_recent_totals", with_(
    RAW_DAILY, API, f"a1 AS ({CSV_FIRST})", f"a2 AS ({API_FIRST})", f"a3 AS ({CSV_ONLY})",
    """u AS (SELECT 'csv_first' AS priority, site_id, day, production_kwh FROM a1
  UNION ALL SELECT 'api_first', site_id, day, production_kwh FROM a2
  UNION ALL SELECT 'csv_only', site_id, day, production_kwh FROM a3)""", select="""
SELECT site_id, count(*) AS records, sum(production_kwh) AS total_kwh, avg(production_kwh) AS average_daily_kwh,
       min(day) AS start_day, max(day) AS end_day, priority FROM u
WHERE day BETWEEN DATE '2000-06-01' AND DATE '2000-07-01' GROUP BY site_id, priority"""),
    "site_id:i records:i total_kwh:f average_daily_kwh:f start_day:d end_day:d priority:s")
def c4_recent(spark, d):
    return merging.recent_totals(A.daily_raw(spark, d), A.api_daily(spark, d), "2000-07-01", 30)


@query("c5_source_overlap", with_(RAW_DAILY, API, select="""
SELECT coalesce(r.site_id, a.site_id) AS site_id, count(*) FILTER (r.day IS NOT NULL AND a.day IS NOT NULL) AS "both",
  count(*) FILTER (a.day IS NULL) AS csv_only, count(*) FILTER (r.day IS NULL) AS api_only
FROM raw_daily r FULL JOIN api a ON r.site_id = a.site_id AND r.day = a.day GROUP BY 1"""),
    'site_id:i "both":i csv_only:i api_only:i')
def c5(spark, d):
    return merging.source_overlap(A.daily_raw(spark, d), A.api_daily(spark, d))


@query("c6_incremental_update", with_(RAW_DAILY, API, select="""
SELECT site_id, day, production_kwh, consumption_kwh, export_kwh, import_kwh FROM raw_daily
UNION ALL SELECT a.site_id, a.day, a.production_kwh, NULL, NULL, NULL FROM api a
  ANTI JOIN raw_daily r ON a.site_id = r.site_id AND a.day = r.day"""), f"{KEY} {ENERGY_F}")
def c6(spark, d):
    return merging.incremental_update(A.daily_raw(spark, d), A.api_daily(spark, d))[0]


@query("c6_update_statistics", with_(RAW_DAILY, API, select="""
SELECT coalesce(r.site_id, a.site_id) AS site_id, count(r.day) AS existing_records, count(a.day) AS api_records,
  count(*) FILTER (r.day IS NULL) AS new_records, count(*) FILTER (r.day IS NOT NULL AND a.day IS NOT NULL) AS updated_records
FROM raw_daily r FULL JOIN api a ON r.site_id = a.site_id AND r.day = a.day GROUP BY 1"""),
    "site_id:i existing_records:i api_records:i new_records:i updated_records:i")
def c6_stats(spark, d):
    return merging.incremental_update(A.daily_raw(spark, d), A.api_daily(spark, d))[1]


@query("c6_upsert_fresh", with_(RAW_DAILY, API, select="""
SELECT r.site_id, r.day, coalesce(a.production_kwh, r.production_kwh) AS production_kwh, consumption_kwh, export_kwh, import_kwh
FROM raw_daily r LEFT JOIN api a ON r.site_id = a.site_id AND r.day = a.day
UNION ALL SELECT a.site_id, a.day, a.production_kwh, NULL, NULL, NULL FROM api a
  ANTI JOIN raw_daily r ON a.site_id = r.site_id AND a.day = r.day"""), f"{KEY} {ENERGY_F}")
def c6_fresh(spark, d):
    return merging.incremental_update(A.daily_raw(spark, d), A.api_daily(spark, d), "fresh")[0]


CITIES = values("cities", [(i, *c) for i, c in enumerate(dims.CITIES)],
                "pos, city, latitude, longitude, timezone, location_name")
SITES = CITIES + """,
sites AS (SELECT s.site_id, c.city, c.latitude, c.longitude, c.timezone, c.location_name
  FROM (SELECT DISTINCT s_suppkey // 10 AS site_id FROM supplier) s JOIN cities c ON c.pos = s.site_id % 12)"""
RATES = values("rates", dims.STATE_RATES, "state_name, state, rate")
ANCHORS = values("anchors", [(i, *a) for i, a in enumerate(dims.RATE_ANCHORS)], "pos, lat, lon, state")
NEAREST = SITES + ",\n" + RATES + ",\n" + ANCHORS + """,
near AS (SELECT site_id, state FROM (
  SELECT s.site_id, a.state, a.pos, sqrt((latitude - lat) * (latitude - lat) + (longitude - lon) * (longitude - lon)) AS dist
  FROM sites s, anchors a) x WHERE dist < 5.0
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY dist, pos) = 1),
tariff0 AS (SELECT s.site_id, s.city, n.state, coalesce(r.rate, 16.22) AS residential_rate,
  CASE WHEN r.rate IS NULL THEN 'national_average' ELSE 'state_average' END AS source,
  CASE WHEN r.rate IS NULL THEN 'low' ELSE 'medium' END AS confidence
  FROM sites s LEFT JOIN near n USING (site_id) LEFT JOIN rates r ON r.state = n.state)"""
TARIFFS = NEAREST + """,
tariffs AS (SELECT site_id, state, residential_rate, residential_rate * 0.80 AS feed_in_tariff,
  residential_rate / 100.0 AS annual_cost_per_kwh, residential_rate * 0.80 / 100.0 AS feed_in_rate_per_kwh FROM tariff0)"""


@query("c7_nearest_tariff", with_(NEAREST, select="SELECT * FROM tariff0"),
       "site_id:i city:s state:s residential_rate:f source:s confidence:s")
def c7(spark, d):
    return tariffs.nearest_tariff(A.sites(spark, d)).select(
        "site_id", "city", "state", "residential_rate", "source", "confidence")


@query("c7_nearest_anchor_table", """
WITH s AS (SELECT c_custkey AS site_id, 20 + c_custkey * 37 % 400 / 8.0 AS latitude, -130 + c_custkey * 91 % 800 / 8.0 AS longitude FROM customer),
a AS (SELECT s_suppkey AS anchor, 25 + s_suppkey * 53 % 240 / 8.0 AS latitude, -125 + s_suppkey * 29 % 560 / 8.0 AS longitude FROM supplier),
p AS (SELECT site_id, anchor, sqrt((s.latitude - a.latitude) * (s.latitude - a.latitude) + (s.longitude - a.longitude) * (s.longitude - a.longitude)) AS d FROM s, a),
n AS (SELECT * FROM p WHERE d < 5 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d, anchor) = 1)
SELECT site_id, anchor, d AS anchor_distance FROM s LEFT JOIN n USING (site_id)""", "site_id:i anchor:i anchor_distance:f")
def c7_table(spark, d):
    """Customers as sites and suppliers as anchors, placed on a lattice of eighths of a degree."""
    sites = A.table(spark, d, "customer").selectExpr(
        "c_custkey AS site_id", "20 + c_custkey * 37 % 400 / 8D AS latitude", "-130 + c_custkey * 91 % 800 / 8D AS longitude")
    anchors = A.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS anchor", "25 + s_suppkey * 53 % 240 / 8D AS latitude", "-125 + s_suppkey * 29 % 560 / 8D AS longitude")
    return tariffs.nearest_anchor(sites, anchors).select("site_id", "anchor", "anchor_distance")


# every other site by state name, the rest by abbreviation; one in seven is unknown
STATE_TEXT = """CASE WHEN c_custkey % 7 = 6 THEN 'Atlantis' WHEN c_custkey % 2 = 0 THEN 'New York'
  WHEN c_custkey % 3 = 0 THEN 'tx' ELSE 'CA' END"""


@query("c8_tariff_by_state", with_(RATES, select=f"""
SELECT c_custkey AS site_id, {STATE_TEXT} AS state, r.state AS state_code, coalesce(rate, 16.22) AS residential_rate,
  CASE WHEN rate IS NULL THEN 'national_average' ELSE 'state_average' END AS source,
  CASE WHEN rate IS NULL THEN 'low' ELSE 'medium' END AS confidence
FROM customer LEFT JOIN rates r ON r.state_name = replace(lower({STATE_TEXT}), ' ', '_') OR r.state = upper({STATE_TEXT})"""),
    "site_id:i state:s state_code:s residential_rate:f source:s confidence:s")
def c8(spark, d):
    df = A.table(spark, d, "customer").select(F.col("c_custkey").alias("site_id"),
                                              F.expr(STATE_TEXT).alias("state"))
    return tariffs.tariff_by_state(df)


@query("c9_rate_summary", with_(TARIFFS, select="""
SELECT site_id, state, residential_rate, feed_in_tariff, annual_cost_per_kwh, feed_in_rate_per_kwh,
  residential_rate - 16.22 AS vs_national_avg, CASE WHEN residential_rate > 16.22 THEN 1 ELSE 0 END AS is_above_average FROM tariffs"""),
    "site_id:i state:s residential_rate:f feed_in_tariff:f annual_cost_per_kwh:f feed_in_rate_per_kwh:f "
    "vs_national_avg:f is_above_average:i")
def c9(spark, d):
    return tariffs.rate_summary(tariffs.nearest_tariff(A.sites(spark, d))).select(
        "site_id", "state", "residential_rate", "feed_in_tariff", "annual_cost_per_kwh",
        "feed_in_rate_per_kwh", "vs_national_avg", "is_above_average")


@query("c10_day_spine_fill", with_(DAILY, select="SELECT * FROM daily"), f"{KEY} {ENERGY_F}")
def c10(spark, d):
    return daily(spark, d)


@query("c11_mean_broadcast_back", with_(DAILY, select="""
SELECT site_id, day, production_kwh, avg(production_kwh) OVER (PARTITION BY site_id, month(day)) AS month_mean FROM daily"""),
    f"{KEY} production_kwh:f month_mean:f")
def c11(spark, d):
    return merging.broadcast_back(daily(spark, d), "production_kwh", ("site_id", F.month("day")),
                                  "month_mean").select("site_id", "day", "production_kwh", "month_mean")
