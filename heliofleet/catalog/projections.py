"""Row-wise operators, filters and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import distribution, merging, metrics, selection, timeline
from ..schema import ENERGY as COLS
from ..sources import adapters as A
from . import ingest
from .base import (API, DAILY, ENERGY_F, INTERVALS, INTERVALS_WH, MERGED, RAW_DAILY, catalog,
                   with_)
from .common import daily, merged

CATALOG, query = catalog()
KEY = "site_id:i day:d"

NET = """production_kwh - consumption_kwh AS net_energy_kwh,
  CASE WHEN production_kwh > consumption_kwh THEN 1 ELSE 0 END AS energy_surplus,
  CASE WHEN consumption_kwh = 0 THEN CASE WHEN production_kwh > 0 THEN 100.0 END
       WHEN production_kwh / consumption_kwh * 100 > 100 THEN 100.0
       ELSE production_kwh / consumption_kwh * 100 END AS self_sufficiency_pct"""
SELF = """production_kwh - export_kwh AS self_consumed_kwh,
  CASE WHEN production_kwh = 0 THEN 0.0 ELSE greatest(0.0, least(100.0,
       (production_kwh - export_kwh) / production_kwh * 100)) END AS self_consumption_rate_pct,
  CASE WHEN consumption_kwh = 0 THEN 0.0 ELSE greatest(0.0, least(100.0,
       (production_kwh - export_kwh) / consumption_kwh * 100)) END AS grid_independence_pct"""
NET_F = "net_energy_kwh:f energy_surplus:i self_sufficiency_pct:f"
SELF_F = "self_consumed_kwh:f self_consumption_rate_pct:f grid_independence_pct:f"


@query("b1_net_energy", with_(DAILY, select=f"SELECT *, {NET} FROM daily"), f"{KEY} {ENERGY_F} {NET_F}")
def b1(spark, d):
    return metrics.net_energy(daily(spark, d))


@query("b2_self_consumption", with_(DAILY, select=f"SELECT *, {SELF} FROM daily"),
       f"{KEY} {ENERGY_F} {SELF_F}")
def b2(spark, d):
    return metrics.self_consumption(daily(spark, d))


@query("b3_date_range", with_(RAW_DAILY, select="""
SELECT * FROM raw_daily WHERE day BETWEEN DATE '1996-03-01' AND DATE '1997-08-31'"""),
       f"{KEY} {ENERGY_F}")
def b3(spark, d):
    return merging.date_range_filter(A.daily_raw(spark, d), "1996-03-01", "1997-08-31")


B4 = """SELECT site_id, ts, production_kwh, consumption_kwh, export_kwh, import_kwh, 'csv' AS source, DATE '2024-01-10' AS day
FROM intervals WHERE CAST(ts AS DATE) = DATE '2024-01-10'"""


@query("b4_intervals_for_day", with_(INTERVALS, select=B4), f"site_id:i ts:t day:d source:s {ENERGY_F}")
def b4(spark, d):
    return merging.intervals_for_day(A.intervals(spark, d), ingest.meter(spark, d), "2024-01-10")


@query("b4_fallback_for_day", with_(INTERVALS, ingest.METER, select="""
SELECT site_id, ts, sum(wh / 1000.0) AS production_kwh, CAST(NULL AS DOUBLE) AS consumption_kwh,
       CAST(NULL AS DOUBLE) AS export_kwh, CAST(NULL AS DOUBLE) AS import_kwh, 'api' AS source, DATE '2024-01-10' AS day
FROM meter WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1, 2"""),
    f"site_id:i ts:t day:d source:s {ENERGY_F}")
def b4_fallback(spark, d):
    # the interval feed ends before the wanted day, so every site falls back
    early = A.intervals(spark, d).where("ts < TIMESTAMP '2024-01-10'")
    return merging.intervals_for_day(early, ingest.meter(spark, d), "2024-01-10")


@query("b5_hour_filter", with_(INTERVALS, select="SELECT * FROM intervals WHERE hour(ts) IN (11, 12, 13)"),
       f"site_id:i ts:t {ENERGY_F}")
def b5(spark, d):
    return selection.hour_filter(A.intervals(spark, d), (11, 12, 13))


@query("b6_producing_only", with_(INTERVALS_WH, ingest.METER, select="""
SELECT site_id, max(wh * 4) AS peak_power_w, avg(wh * 4) AS avg_power_w, count(*) AS producing_intervals
FROM meter WHERE wh > 0 GROUP BY 1"""), "site_id:i peak_power_w:f avg_power_w:f producing_intervals:i")
def b6(spark, d):
    return selection.power_summary(ingest.meter(spark, d))


@query("b6_first_of_day", with_(INTERVALS_WH, ingest.METER, select="""
SELECT site_id, CAST(ts AS DATE) AS day, ts, channel, wh * 4 AS current_power_w FROM meter WHERE wh > 0
QUALIFY row_number() OVER (PARTITION BY site_id, CAST(ts AS DATE) ORDER BY ts, channel) = 1"""),
    f"{KEY} ts:t channel:i current_power_w:f")
def b6_first(spark, d):
    return selection.first_of_day(ingest.meter(spark, d))


@query("b7_drop_incomplete", with_(INTERVALS, select="""
SELECT * FROM intervals WHERE production_kwh IS NOT NULL AND consumption_kwh IS NOT NULL"""),
    f"site_id:i ts:t {ENERGY_F}")
def b7(spark, d):
    return selection.drop_incomplete(A.intervals(spark, d), ("production_kwh", "consumption_kwh"))


W7 = "OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query("b8_fill_missing", with_(RAW_DAILY, f"""f AS (
  SELECT site_id, day, lag(production_kwh, 3) OVER (PARTITION BY site_id ORDER BY day) AS lag_3d,
         CASE WHEN count(production_kwh) {W7} = 7 THEN avg(production_kwh) {W7} END AS rolling_mean_7d,
         CASE WHEN consumption_kwh > 100 THEN consumption_kwh END AS heavy FROM raw_daily)""", select="""
SELECT site_id, day, coalesce(last_value(lag_3d IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY day
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS lag_3d,
       coalesce(rolling_mean_7d, avg(rolling_mean_7d) OVER (PARTITION BY site_id), 0) AS rolling_mean_7d,
       coalesce(heavy, 0) AS heavy FROM f"""), f"{KEY} lag_3d:f rolling_mean_7d:f heavy:f")
def b8(spark, d):
    from ..operators import windows

    df = A.daily_raw(spark, d).select(
        "site_id", "day", F.lag("production_kwh", 3).over(windows.by_day()).alias("lag_3d"),
        windows.strict(F.avg, "production_kwh", 7).alias("rolling_mean_7d"),
        F.when(F.col("consumption_kwh") > 100, F.col("consumption_kwh")).alias("heavy"))
    return selection.fill_missing(df)


@query("b9_new_columns", with_(DAILY, select=f"SELECT site_id, day, {NET} FROM daily"), f"{KEY} {NET_F}")
def b9(spark, d):
    before = daily(spark, d)
    return selection.new_columns(before, metrics.net_energy(before))


@query("b20_correlation_strength", with_(MERGED, "r AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{c}' AS parameter, corr(production_kwh, {c}) AS r FROM merged GROUP BY 1"
    for c in ("temperature", "humidity", "cloud_cover", "consumption_kwh", "production_kwh")) + ")", select="""
SELECT site_id, parameter, r, CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong'
  WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Very Weak' END AS strength
FROM r WHERE r IS NOT NULL AND NOT isnan(r)"""), "site_id:i parameter:s r:f strength:s")
def b20(spark, d):
    return distribution.correlations_with(
        merged(spark, d), ("temperature", "humidity", "cloud_cover", "consumption_kwh", "production_kwh"))


@query("b21_freshness", with_(RAW_DAILY, select="""
SELECT site_id, max(day) AS latest_day, date_diff('day', max(day), DATE '2001-12-01') AS days_old,
  CASE WHEN date_diff('day', max(day), DATE '2001-12-01') < 7 THEN 'very recent'
       WHEN date_diff('day', max(day), DATE '2001-12-01') < 30 THEN 'recent'
       WHEN date_diff('day', max(day), DATE '2001-12-01') < 90 THEN 'somewhat old' ELSE 'old' END AS recency
FROM raw_daily GROUP BY 1"""), "site_id:i latest_day:d days_old:i recency:s")
def b21(spark, d):
    return metrics.freshness(A.daily_raw(spark, d), "2001-12-01")


@query("b22_recent_daily", with_(API, select="""
SELECT s.site_id, s.day, coalesce(a.production_kwh, 0) AS production_kwh,
       CASE WHEN coalesce(a.production_kwh, 0) > 0 THEN 1 ELSE 0 END AS has_data
FROM (SELECT DISTINCT site_id, CAST(unnest(generate_series(TIMESTAMP '2000-06-08', TIMESTAMP '2000-06-14',
      INTERVAL 1 DAY)) AS DATE) AS day FROM api) s LEFT JOIN api a USING (site_id, day)"""),
    f"{KEY} production_kwh:f has_data:i")
def b22(spark, d):
    return merging.recent_daily(A.api_daily(spark, d), "2000-06-15", 7)


TIME = """dayofyear(day) AS day_of_year, isodow(day) - 1 AS day_of_week, month(day) AS month,
  quarter(day) AS quarter, weekofyear(day) AS week_of_year,
  CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN isodow(day) = 1 THEN 1 ELSE 0 END AS is_monday,
  CASE WHEN month(day) IN (12, 1, 2) THEN 1 ELSE 0 END AS is_winter, CASE WHEN month(day) IN (3, 4, 5) THEN 1 ELSE 0 END AS is_spring,
  CASE WHEN month(day) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_summer, CASE WHEN month(day) IN (9, 10, 11) THEN 1 ELSE 0 END AS is_fall"""
TIME_F = ("day_of_year:i day_of_week:i month:i quarter:i week_of_year:i is_weekend:i is_monday:i "
          "is_winter:i is_spring:i is_summer:i is_fall:i")


def cycle_sql(names):
    parts = {"day": ("dayofyear(day)", "365.25"), "week": ("(isodow(day) - 1)", "7.0"),
             "month": ("month(day)", "12.0"), "quarter": ("quarter(day)", "4.0")}
    return ", ".join(f"{f}(2 * pi() * {parts[n][0]} / {parts[n][1]}) AS {n}_{f}"
                     for n in names for f in ("sin", "cos"))


def cycle_f(names):
    return " ".join(f"{n}_{f}:f" for n in names for f in ("sin", "cos"))


SOLSTICE = """least(abs(dayofyear(day) - 172), 365 - abs(dayofyear(day) - 172)) AS days_from_summer_solstice,
  1 - least(abs(dayofyear(day) - 172), 365 - abs(dayofyear(day) - 172)) / 182.5 AS seasonal_strength"""
CYCLES = ("day", "week", "month", "quarter")


@query("f1_time_features", with_(DAILY, select=f"SELECT site_id, day, {TIME} FROM daily"), f"{KEY} {TIME_F}")
def f1(spark, d):
    return daily(spark, d).select("site_id", "day", *[
        c.alias(n) for n, c in cal.time_feature_columns("day").items()])


@query("f1c_cyclical_features", with_(DAILY, select=f"SELECT site_id, day, {cycle_sql(CYCLES)} FROM daily"),
       f"{KEY} {cycle_f(CYCLES)}")
def f1c(spark, d):
    return daily(spark, d).select("site_id", "day", *[
        c.alias(n) for n, c in cal.cyclical_columns("day").items()])


@query("f1s_solstice_features", with_(DAILY, select=f"SELECT site_id, day, {SOLSTICE} FROM daily"),
       f"{KEY} days_from_summer_solstice:i seasonal_strength:f")
def f1s(spark, d):
    return daily(spark, d).select("site_id", "day", *[
        c.alias(n) for n, c in cal.solstice_columns("day").items()])


@query("h3_best_and_worst_day", with_(DAILY, select="""
SELECT site_id, (arg_max(day, (production_kwh, -epoch(day)))) AS best_day, max(production_kwh) AS best_kwh,
       (arg_min(day, (production_kwh, epoch(day)))) AS worst_day, min(production_kwh) AS worst_kwh
FROM daily GROUP BY 1"""), "site_id:i best_day:d best_kwh:f worst_day:d worst_kwh:f")
def h3(spark, d):
    p = F.col("production_kwh")
    return daily(spark, d).groupBy("site_id").agg(
        F.min_by("day", F.struct(-p, F.col("day"))).alias("best_day"), F.max(p).alias("best_kwh"),
        F.min_by("day", F.struct(p, F.col("day"))).alias("worst_day"), F.min(p).alias("worst_kwh"))


def _ranked(order, n):
    return f"""SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY {order}) AS rank FROM raw_daily
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY {order}) <= {n}"""


@query("h5_head", with_(RAW_DAILY, select=_ranked("day", 5)), f"{KEY} {ENERGY_F} rank:i")
def h5_head(spark, d):
    return selection.head(A.daily_raw(spark, d), 5)


@query("h5_tail", with_(RAW_DAILY, select=_ranked("day DESC", 60)), f"{KEY} {ENERGY_F} rank:i")
def h5_tail(spark, d):
    return selection.tail(A.daily_raw(spark, d), 60)


GAPS = """times AS (SELECT site_id, ts, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS prev_ts FROM intervals),
steps AS (SELECT site_id, prev_ts, ts, CAST(epoch(ts) - epoch(prev_ts) AS BIGINT) AS step FROM times WHERE prev_ts IS NOT NULL),
common AS (SELECT site_id, step AS expected_seconds FROM (
  SELECT site_id, step, count(*) AS n FROM steps GROUP BY 1, 2) c
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, step) = 1)"""
GAP_ROWS = """SELECT s.site_id, prev_ts AS gap_start, ts AS gap_end, step AS gap_seconds, expected_seconds
FROM steps s JOIN common USING (site_id) WHERE step > expected_seconds * 1.5"""


@query("h6_gaps_by_size", with_(INTERVALS, GAPS, select=GAP_ROWS),
       "site_id:i gap_start:t gap_end:t gap_seconds:i expected_seconds:i")
def h6(spark, d):
    return selection.largest_gaps(timeline.time_gaps(A.intervals(spark, d)))


@query("i1_union_sources", with_(RAW_DAILY, API, select="""
SELECT site_id, day, production_kwh, consumption_kwh, export_kwh, import_kwh FROM raw_daily
UNION ALL SELECT site_id, day, production_kwh, NULL, NULL, NULL FROM api"""), f"{KEY} {ENERGY_F}")
def i1(spark, d):
    return A.daily_raw(spark, d).unionByName(A.api_daily(spark, d), allowMissingColumns=True).select(
        "site_id", "day", *COLS)


@query("i2_day_difference", with_(RAW_DAILY, API, select="""
SELECT site_id, day FROM api EXCEPT SELECT site_id, day FROM raw_daily"""), KEY)
def i2(spark, d):
    return merging.day_difference(A.api_daily(spark, d), A.daily_raw(spark, d))


@query("i3_day_intersection", with_(RAW_DAILY, API, select="""
SELECT site_id, day FROM api INTERSECT SELECT site_id, day FROM raw_daily"""), KEY)
def i3(spark, d):
    return merging.day_intersection(A.api_daily(spark, d), A.daily_raw(spark, d))


@query("i4_distinct_channels", with_(INTERVALS_WH, ingest.METER, select="SELECT DISTINCT site_id, channel FROM meter"),
       "site_id:i channel:i")
def i4(spark, d):
    return merging.distinct_values(ingest.meter(spark, d), "channel")


