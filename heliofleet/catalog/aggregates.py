"""Rollups, profiles, statistics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import distribution, metrics, profiles, rollup
from ..sources import adapters as A
from . import ingest
from .base import API, DAILY, ENERGY, ENERGY_F, INTERVALS, INTERVALS_WH, MERGED, RAW_DAILY, catalog, with_
from .common import daily, merged
from .projections import NET, NET_F, SELF, SELF_F, TIME, TIME_F

CATALOG, query = catalog()
KEY = "site_id:i day:d"
SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring'
  WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""
MONTHS = "list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], CAST({0} AS BIGINT))"


def _agg(method):
    fn = {"mean": "avg"}.get(method, method)
    return ", ".join(f"{fn}({c}) AS {c}" for c in ENERGY)


def interval_days(method, grain="day"):
    """Days (or months) of the interval feed with the gaps filled."""
    bucket = "CAST(ts AS DATE)" if grain == "day" else "last_day(ts)"
    label = "day" if grain == "day" else "month_end"
    fill = (", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in ENERGY) if method == "sum"
            else ", ".join(f"g.{c}" for c in ENERGY))
    series = (f"CAST(unnest(generate_series(CAST(min({label}) AS TIMESTAMP), CAST(max({label}) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)"
              if grain == "day" else
              f"last_day(CAST(unnest(generate_series(date_trunc('month', min({label})), date_trunc('month', max({label})), INTERVAL 1 MONTH)) AS DATE))")
    return f"""g AS (SELECT site_id, {bucket} AS {label}, {_agg(method)} FROM intervals GROUP BY 1, 2),
sp AS (SELECT site_id, {series} AS {label} FROM g GROUP BY 1),
filled AS (SELECT sp.site_id, sp.{label}, {fill} FROM sp LEFT JOIN g ON g.site_id = sp.site_id AND g.{label} = sp.{label})"""


def _daily(method):
    @query(f"e1_daily_{method}", with_(INTERVALS, interval_days(method), select="SELECT * FROM filled"),
           f"{KEY} {ENERGY_F}")
    def run(spark, d):
        return rollup.daily_summary(A.intervals(spark, d), method)


for _m in ("sum", "mean", "max", "min"):
    _daily(_m)


@query("e1_enhanced_daily", with_(INTERVALS, interval_days("sum"),
                                  select=f"SELECT *, {NET}, {SELF}, {TIME} FROM filled"),
       f"{KEY} {ENERGY_F} {NET_F} {SELF_F} {TIME_F}")
def e1_enhanced(spark, d):
    return rollup.enhanced_daily_summary(A.intervals(spark, d))


def monthly_sql(method):
    fill = (", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in ENERGY) if method == "sum"
            else ", ".join(f"g.{c}" for c in ENERGY))
    return f"""g AS (SELECT site_id, last_day(day) AS month_end, {_agg(method)} FROM raw_daily GROUP BY 1, 2),
sp AS (SELECT site_id, last_day(CAST(unnest(generate_series(CAST(date_trunc('month', min(month_end)) AS TIMESTAMP),
  CAST(date_trunc('month', max(month_end)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM g GROUP BY 1),
monthly AS (SELECT sp.site_id, sp.month_end, {fill} FROM sp LEFT JOIN g ON g.site_id = sp.site_id AND g.month_end = sp.month_end)"""


def _monthly(method):
    @query(f"e2_monthly_{method}", with_(RAW_DAILY, monthly_sql(method), select="SELECT * FROM monthly"),
           f"site_id:i month_end:d {ENERGY_F}")
    def run(spark, d):
        return rollup.monthly_summary(A.daily_raw(spark, d), method)


for _m in ("sum", "mean", "max", "min"):
    _monthly(_m)


@query("e3_standard_datasets", with_(INTERVALS, interval_days("sum"), select="""
SELECT 'interval' AS dataset, site_id, count(*) AS rows, sum(production_kwh) AS production_kwh FROM intervals GROUP BY 2
UNION ALL SELECT 'daily', site_id, count(*), sum(production_kwh) FROM filled GROUP BY 2
UNION ALL SELECT 'monthly', site_id, count(DISTINCT last_day(day)), sum(production_kwh) FROM filled GROUP BY 2
UNION ALL SELECT 'daily_with_metrics', site_id, count(*), sum(production_kwh) FROM filled GROUP BY 2"""),
    "dataset:s site_id:i rows:i production_kwh:f")
def e3(spark, d):
    out = None
    for name, df in rollup.standard_datasets(A.intervals(spark, d)).items():
        part = df.groupBy("site_id").agg(F.count(F.lit(1)).alias("rows"),
                                         F.sum("production_kwh").alias("production_kwh"))
        part = part.withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


PROFILE = "profile AS (SELECT site_id, hour(ts) AS hour, " + ", ".join(
    f"avg({c}) AS avg_{c}, avg({c}) * 4 AS {c}_per_hour" for c in ENERGY) + " FROM intervals GROUP BY 1, 2)"


@query("e4_hourly_profile", with_(INTERVALS, PROFILE, select="SELECT * FROM profile"),
       "site_id:i hour:i " + " ".join(f"avg_{c}:f {c}_per_hour:f" for c in ENERGY))
def e4(spark, d):
    return profiles.hourly_profile(A.intervals(spark, d))


def _peak(c):
    return (f"(SELECT hour FROM profile q WHERE q.site_id = p.site_id AND avg_{c} IS NOT NULL "
            f"ORDER BY avg_{c} DESC, hour LIMIT 1) AS peak_{c.split('_')[0]}_hour")


@query("e5_profile_highlights", with_(INTERVALS, PROFILE, select=f"""
SELECT p.*, (SELECT count(*) FROM profile q WHERE q.site_id = p.site_id AND q.avg_production_kwh > p.peak_production_kwh * 0.5) AS peak_period_hours
FROM (SELECT p.site_id, {', '.join(_peak(c) for c in ENERGY)}, max(avg_production_kwh) AS peak_production_kwh,
  min(hour) FILTER (avg_production_kwh > 0.01) AS first_hour, max(hour) FILTER (avg_production_kwh > 0.01) AS last_hour,
  count(*) FILTER (avg_production_kwh > 0.01) AS productive_hours FROM profile p GROUP BY p.site_id) p"""),
    "site_id:i peak_production_hour:i peak_consumption_hour:i peak_export_hour:i peak_import_hour:i "
    "peak_production_kwh:f first_hour:i last_hour:i productive_hours:i peak_period_hours:i")
def e5(spark, d):
    return profiles.profile_highlights(profiles.hourly_profile(A.intervals(spark, d)))


@query("e6_seasonal_hourly_profile", with_(INTERVALS, API, """
h AS (SELECT o_custkey // 150 AS site_id, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts,
  floor(o_totalprice / 1250) / 8.0 AS production_kwh FROM orders),
s AS (SELECT site_id, coalesce(avg(production_kwh) FILTER (month(ts) = 1) > avg(production_kwh) FILTER (month(ts) = 7), false) AS southern
  FROM h GROUP BY 1)""", select="""
SELECT h.site_id, CASE WHEN (month(ts) IN (6, 7, 8)) <> southern THEN 'Summer' ELSE 'Winter' END AS season,
  hour(ts) AS hour, avg(production_kwh) AS avg_production_kwh
FROM h JOIN s USING (site_id) WHERE month(ts) IN (12, 1, 2, 6, 7, 8) GROUP BY 1, 2, 3"""),
    "site_id:i season:s hour:i avg_production_kwh:f")
def e6(spark, d):
    hours = A.table(spark, d, "orders").select(
        F.expr("o_custkey div 150").alias("site_id"),
        F.expr("o_orderdate + make_dt_interval(0, o_orderkey % 24)").alias("ts"),
        (F.floor(F.col("o_totalprice") / 1250) / F.lit(8.0)).alias("production_kwh"))
    return profiles.seasonal_hourly_profile(hours)


MOY = """m AS (SELECT site_id, month(day) AS month, round(avg(production_kwh), 2) AS mean, round(sum(production_kwh), 2) AS sum,
  round(stddev_samp(production_kwh), 2) AS std, round(min(production_kwh), 2) AS min, round(max(production_kwh), 2) AS max,
  count(production_kwh) AS count FROM daily GROUP BY 1, 2)"""


@query("e7_month_of_year_stats", with_(DAILY, MOY, select=f"""
SELECT m.*, {MONTHS.format('month')} AS month_name,
  first_value(month) OVER (PARTITION BY site_id ORDER BY mean DESC, month) AS best_month,
  first_value(month) OVER (PARTITION BY site_id ORDER BY mean, month) AS worst_month,
  max(mean) OVER (PARTITION BY site_id) / min(mean) OVER (PARTITION BY site_id) AS seasonal_variation FROM m"""),
    "site_id:i month:i mean:f sum:f std:f min:f max:f count:i month_name:s best_month:i worst_month:i seasonal_variation:f")
def e7(spark, d):
    return profiles.month_of_year_stats(daily(spark, d))


@query("e8_quarter_stats", with_(DAILY, "q AS (SELECT site_id, quarter(day) AS quarter, avg(production_kwh) AS mean FROM daily GROUP BY 1, 2)", select="""
SELECT q.*, list_extract(['Winter','Spring','Summer','Fall'], CAST(quarter AS BIGINT)) AS season,
  first_value(quarter) OVER (PARTITION BY site_id ORDER BY mean DESC, quarter) AS best_quarter,
  first_value(quarter) OVER (PARTITION BY site_id ORDER BY mean, quarter) AS worst_quarter,
  max(mean) OVER (PARTITION BY site_id) / min(mean) OVER (PARTITION BY site_id) AS variation FROM q"""),
    "site_id:i quarter:i mean:f season:s best_quarter:i worst_quarter:i variation:f")
def e8(spark, d):
    return profiles.quarter_stats(daily(spark, d))


@query("e9_season_stats", with_(DAILY, select=f"""
SELECT site_id, {SEASON.format('day')} AS season, avg(production_kwh) AS mean, stddev_samp(production_kwh) AS std,
  var_samp(production_kwh) AS variance FROM daily GROUP BY 1, 2"""), "site_id:i season:s mean:f std:f variance:f")
def e9(spark, d):
    return profiles.season_stats(daily(spark, d))


@query("e10_calendar_month_totals", with_(DAILY, select="""
SELECT site_id, CAST(date_trunc('month', day) AS DATE) AS month_start, avg(production_kwh) AS mean, sum(production_kwh) AS sum
FROM daily GROUP BY 1, 2"""), "site_id:i month_start:d mean:f sum:f")
def e10(spark, d):
    return profiles.calendar_month_totals(daily(spark, d))


DAYLIGHT = "(12 + 4 * sin(2 * pi() * (dayofyear(day) - 81) / 365.0))"


@query("e11_monthly_efficiency", with_(DAILY, select=f"""
SELECT site_id, month(day) AS month, avg(production_kwh / {DAYLIGHT}) AS kwh_per_daylight_hour FROM daily GROUP BY 1, 2"""),
    "site_id:i month:i kwh_per_daylight_hour:f")
def e11(spark, d):
    return profiles.monthly_efficiency(daily(spark, d))


@query("e12_monthly_savings", with_(RAW_DAILY, select=f"""
SELECT s.site_id, s.month, {MONTHS.format('s.month')} AS month_name, coalesce(sum(production_kwh), 0) * 0.12 AS savings
FROM (SELECT DISTINCT site_id, unnest(range(1, 13)) AS month FROM raw_daily) s
LEFT JOIN raw_daily r ON r.site_id = s.site_id AND month(r.day) = s.month GROUP BY 1, 2"""),
    "site_id:i month:i month_name:s savings:f")
def e12(spark, d):
    return profiles.monthly_savings(A.daily_raw(spark, d), 0.12)


PEAKS = """pk AS (SELECT site_id, CAST(date_trunc('month', day) AS DATE) AS month_start, max(production_kwh) AS peak_kwh FROM daily GROUP BY 1, 2),
peaks AS (SELECT *, CAST(date_diff('day', min(month_start) OVER (PARTITION BY site_id), month_start) AS DOUBLE) AS day_offset FROM pk),
fit AS (SELECT site_id, regr_slope(peak_kwh, day_offset) AS slope, regr_intercept(peak_kwh, day_offset) AS intercept FROM peaks GROUP BY 1)"""


@query("e13_monthly_peaks", with_(DAILY, PEAKS, select="SELECT p.*, slope, intercept FROM peaks p JOIN fit USING (site_id)"),
       "site_id:i month_start:d peak_kwh:f day_offset:f slope:f intercept:f")
def e13(spark, d):
    return profiles.monthly_peaks(daily(spark, d))


@query("e13_peak_trend", with_(DAILY, PEAKS, select="""
SELECT site_id, avg(peak_kwh) FILTER (f <= 6) AS early_mean, avg(peak_kwh) FILTER (l <= 6) AS recent_mean, count(*) AS months,
  max(slope) AS slope, CASE WHEN avg(peak_kwh) FILTER (l <= 6) > avg(peak_kwh) FILTER (f <= 6) THEN 'improving' ELSE 'declining' END AS trend
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY month_start) AS f,
      row_number() OVER (PARTITION BY site_id ORDER BY month_start DESC) AS l FROM peaks JOIN fit USING (site_id)) t
GROUP BY 1 HAVING count(*) > 6"""), "site_id:i early_mean:f recent_mean:f months:i slope:f trend:s")
def e13_trend(spark, d):
    return profiles.peak_trend(profiles.monthly_peaks(daily(spark, d)))


@query("e14_yearly_totals", with_(DAILY, """y AS (SELECT site_id, year(day) AS year, sum(production_kwh) AS total, count(*) AS days FROM daily GROUP BY 1, 2)""", select="""
SELECT site_id, year, total, days, total - lag(total) OVER w AS change,
  CASE WHEN lag(total) OVER w <> 0 THEN (total - lag(total) OVER w) / lag(total) OVER w * 100 END AS change_pct
FROM y WINDOW w AS (PARTITION BY site_id ORDER BY year) QUALIFY sum(days) OVER (PARTITION BY site_id) > 365"""),
    "site_id:i year:i total:f days:i change:f change_pct:f")
def e14(spark, d):
    return profiles.yearly_totals(daily(spark, d))


@query("e15_channel_totals", with_(INTERVALS_WH, ingest.METER, select="""
SELECT site_id, channel, sum(wh / 1000.0) AS total_kwh, count(*) AS intervals FROM meter GROUP BY 1, 2"""),
    "site_id:i channel:i total_kwh:f intervals:i")
def e15(spark, d):
    return profiles.channel_totals(ingest.meter(spark, d))


@query("e16_production_statistics", with_(DAILY, "mm AS (SELECT site_id, avg(production_kwh) AS m FROM daily GROUP BY 1)", select="""
SELECT site_id, sum(production_kwh) AS total_production, avg(production_kwh) AS average_daily,
  quantile_cont(production_kwh, 0.5) AS median_daily, stddev_samp(production_kwh) AS std_deviation,
  min(production_kwh) AS min_daily, max(production_kwh) AS max_daily, quantile_cont(production_kwh, 0.25) AS quartile_25,
  quantile_cont(production_kwh, 0.75) AS quartile_75, count(*) FILTER (production_kwh > m * 0.1) AS productive_days,
  count(*) FILTER (production_kwh = 0) AS zero_production_days, count(*) AS analysis_period,
  CASE WHEN avg(production_kwh) > 0 THEN stddev_samp(production_kwh) / avg(production_kwh) ELSE 0 END AS coefficient_of_variation,
  count(*) FILTER (production_kwh > m * 0.1) / count(*) * 100 AS productive_days_pct
FROM daily JOIN mm USING (site_id) GROUP BY 1"""),
    "site_id:i total_production:f average_daily:f median_daily:f std_deviation:f min_daily:f max_daily:f quartile_25:f "
    "quartile_75:f productive_days:i zero_production_days:i analysis_period:i coefficient_of_variation:f productive_days_pct:f")
def e16(spark, d):
    return metrics.production_statistics(daily(spark, d))


@query("e17_consumption_statistics", with_(DAILY, select="""
SELECT site_id, sum(consumption_kwh) AS total_consumption, avg(consumption_kwh) AS average_daily, min(consumption_kwh) AS min_daily,
  max(consumption_kwh) AS max_daily, stddev_samp(consumption_kwh) AS std_deviation, sum(export_kwh) AS total_export,
  sum(import_kwh) AS total_import, sum(export_kwh) - sum(import_kwh) AS net_export,
  sum(production_kwh) - sum(export_kwh) AS self_consumption_kwh,
  CASE WHEN sum(production_kwh) > 0 THEN (sum(production_kwh) - sum(export_kwh)) / sum(production_kwh) * 100 ELSE 0 END AS self_consumption_rate,
  CASE WHEN sum(consumption_kwh) > 0 THEN (1 - sum(import_kwh) / sum(consumption_kwh)) * 100 ELSE 0 END AS grid_independence_rate
FROM daily GROUP BY 1"""),
    "site_id:i total_consumption:f average_daily:f min_daily:f max_daily:f std_deviation:f total_export:f total_import:f "
    "net_export:f self_consumption_kwh:f self_consumption_rate:f grid_independence_rate:f")
def e17(spark, d):
    return metrics.consumption_statistics(daily(spark, d))


@query("e18_surplus_days", with_(DAILY, select="""
SELECT site_id, count(*) FILTER (production_kwh > consumption_kwh) AS surplus_days, count(*) AS days,
  sum(production_kwh - consumption_kwh) AS net_balance_kwh, sum(export_kwh) AS total_export,
  count(*) FILTER (production_kwh > consumption_kwh) / count(*) * 100 AS surplus_pct,
  CASE WHEN sum(production_kwh) > 0 THEN (sum(production_kwh) - sum(export_kwh)) / sum(production_kwh) * 100 ELSE 0 END AS self_consumption_rate
FROM daily GROUP BY 1"""),
    "site_id:i surplus_days:i days:i net_balance_kwh:f total_export:f surplus_pct:f self_consumption_rate:f")
def e18(spark, d):
    return metrics.surplus_days(daily(spark, d))


@query("e20_describe", with_(DAILY, select=" UNION ALL ".join(f"""
SELECT site_id, '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max
FROM daily GROUP BY 1""" for c in ENERGY)),
    'site_id:i "column":s count:i mean:f std:f min:f p25:f p50:f p75:f max:f')
def e20(spark, d):
    return metrics.describe(daily(spark, d), ENERGY)


def histogram_sql(bins):
    return f"""r AS (SELECT site_id, min(production_kwh) AS lo, max(production_kwh) AS hi FROM daily GROUP BY 1),
b AS (SELECT site_id, least(floor((production_kwh - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin, count(*) AS n
  FROM daily JOIN r USING (site_id) GROUP BY 1, 2),
histo AS (SELECT s.site_id, s.bin, lo + s.bin * ((hi - lo) / {bins}.0) AS bin_start, lo + (s.bin + 1) * ((hi - lo) / {bins}.0) AS bin_end,
  coalesce(n, 0) AS count FROM (SELECT site_id, lo, hi, unnest(range({bins})) AS bin FROM r) s LEFT JOIN b USING (site_id, bin))"""


def _histogram(bins):
    @query(f"e39_histogram_{bins}", with_(DAILY, histogram_sql(bins), select="SELECT * FROM histo"),
           "site_id:i bin:i bin_start:f bin_end:f count:i")
    def run(spark, d):
        return distribution.histogram(daily(spark, d), bins=bins)


_histogram(30)
_histogram(25)


@query("e40_box_stats", with_(DAILY, """q AS (SELECT site_id, month(day) AS month, quantile_cont(production_kwh, 0.25) AS q1,
  quantile_cont(production_kwh, 0.5) AS median, quantile_cont(production_kwh, 0.75) AS q3 FROM daily GROUP BY 1, 2),
j AS (SELECT d.site_id, q.month, q1, median, q3, production_kwh AS v,
  production_kwh BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
  FROM daily d JOIN q ON q.site_id = d.site_id AND q.month = month(d.day))""", select="""
SELECT site_id, month, max(q1) AS q1, max(median) AS median, max(q3) AS q3, min(v) FILTER (inside) AS whisker_low,
  max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM j GROUP BY 1, 2"""),
    "site_id:i month:i q1:f median:f q3:f whisker_low:f whisker_high:f outliers:i n:i")
def e40(spark, d):
    return distribution.box_stats(daily(spark, d))


@query("e42_correlation_matrix", with_(DAILY, "r AS (" + " UNION ALL ".join(
    f"SELECT site_id, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM daily GROUP BY 1"
    for i, a in enumerate(ENERGY) for b in ENERGY[i + 1:]) + ")", select="""
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY r DESC NULLS LAST, a, b) AS rank FROM r"""),
    "site_id:i a:s b:s r:f rank:i")
def e42(spark, d):
    return distribution.correlation_matrix(daily(spark, d), ENERGY)


@query("e43_trend_line", with_(DAILY, select=f"""
SELECT site_id, regr_slope(production_kwh, {DAYLIGHT}) AS slope, regr_intercept(production_kwh, {DAYLIGHT}) AS intercept,
  corr({DAYLIGHT}, production_kwh) AS r, count(*) AS n FROM daily GROUP BY 1"""),
    "site_id:i slope:f intercept:f r:f n:i")
def e43(spark, d):
    return distribution.trend_line(daily(spark, d), cal.approximate_daylight("day"))


@query("e43_temperature_trend", with_(MERGED, select="""
SELECT site_id, regr_slope(production_kwh, temperature) AS slope, regr_intercept(production_kwh, temperature) AS intercept,
  corr(temperature, production_kwh) AS r, count(*) AS n FROM merged WHERE production_kwh IS NOT NULL AND temperature IS NOT NULL GROUP BY 1"""),
    "site_id:i slope:f intercept:f r:f n:i")
def e43_temperature(spark, d):
    return distribution.trend_line(merged(spark, d), "temperature")
