"""Weather impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, weather as Wx
from ..plans import models, reports
from ..sources import adapters as A
from .aggregates import MONTHS, SEASON
from .base import DAILY, MERGED, WX_DAILY, WX_HOURLY, catalog, with_
from .common import daily, merged
from .windows import over

CATALOG, query = catalog()
KEY = "site_id:i day:d"
PARAMS = ("temperature", "humidity", "cloud_cover", "wind_speed", "pressure", "ghi", "dni", "dhi")

FACTORS = """f0 AS (SELECT *, CASE WHEN count(ghi) OVER (PARTITION BY site_id) > 0 THEN
    CASE WHEN ghi = 0 AND production_kwh > 0 THEN 2.0 WHEN ghi = 0 OR production_kwh IS NULL OR ghi IS NULL THEN NULL
      ELSE greatest(0.0, least(2.0, production_kwh / (ghi * 0.15))) END
    ELSE greatest(0.5, least(1.2, 1 - abs(temperature - 25) * 0.004)) END AS efficiency_factor,
  1 - cloud_cover / 100 * 0.8 AS cloud_factor, 1 - humidity / 100 * 0.1 AS humidity_factor, least(1 + wind_speed * 0.02, 1.2) AS wind_factor FROM merged),
factors AS (SELECT *, CASE WHEN efficiency_factor IS NOT NULL THEN greatest(0.0, least(2.0, efficiency_factor * cloud_factor * humidity_factor * wind_factor)) END
  AS combined_weather_efficiency FROM f0)"""
FACTORS_F = "efficiency_factor:f cloud_factor:f humidity_factor:f wind_factor:f combined_weather_efficiency:f"


def names(kinds):
    return [k.split(":")[0] for k in kinds.split()]


@query("b12_weather_factors", with_(MERGED, FACTORS, select="SELECT * FROM factors"), f"site_id:i ts:t production_kwh:f {FACTORS_F}")
def b12(spark, d):
    return Wx.weather_factors(merged(spark, d)).select("site_id", "ts", "production_kwh", *names(FACTORS_F))


@query("b12_temperature_model", with_(MERGED, select="""
SELECT site_id, ts, greatest(0.5, least(1.2, 1 - abs(temperature - 25) * 0.004)) AS efficiency_factor FROM merged"""),
    "site_id:i ts:t efficiency_factor:f")
def b12_temperature(spark, d):
    dark = merged(spark, d).withColumn("ghi", F.lit(None).cast("double"))
    return Wx.weather_factors(dark).select("site_id", "ts", "efficiency_factor")


@query("e49_efficiency_summary", with_(MERGED, FACTORS, select="""
SELECT site_id, avg(combined_weather_efficiency) AS average_efficiency, max(combined_weather_efficiency) AS best_efficiency,
  min(combined_weather_efficiency) AS worst_efficiency FROM factors GROUP BY 1"""),
    "site_id:i average_efficiency:f best_efficiency:f worst_efficiency:f")
def e49(spark, d):
    return Wx.efficiency_summary(Wx.weather_factors(merged(spark, d)))


DAILY_WX = """dw AS (SELECT d.*, w.* EXCLUDE (site_id, day) FROM daily d LEFT JOIN wx_daily w USING (site_id, day)),
sw AS (SELECT *, CASE WHEN sunshine_hours IS NOT NULL THEN greatest(0.0, least(100.0, 50 + greatest(0.0, least(1.0, sunshine_hours / 12)) * 40
  - cloudcover_mean_pct / 100 * 30 + greatest(-1.0, least(1.0, 1 - abs(temp_mean_c - 25) / 25)) * 10
  - CASE WHEN precipitation_mm > 1 THEN 20 ELSE 0 END)) END AS solar_weather_score FROM dw)"""


def daily_wx(spark, d):
    return merging.merge_weather_daily(daily(spark, d), A.weather_daily(spark, d))


@query("b13_solar_weather_score", with_(DAILY, WX_DAILY, DAILY_WX, select="SELECT site_id, day, solar_weather_score FROM sw"), f"{KEY} solar_weather_score:f")
def b13(spark, d):
    return Wx.solar_weather_score(daily_wx(spark, d)).select("site_id", "day", "solar_weather_score")


@query("b14_weather_ratios", with_(DAILY, WX_DAILY, DAILY_WX, select="""
SELECT site_id, day, sunshine_hours / 12 AS sunshine_ratio, 100 - cloudcover_mean_pct AS clear_sky_factor, temp_max_c - temp_min_c AS temp_range FROM dw"""),
    f"{KEY} sunshine_ratio:f clear_sky_factor:f temp_range:f")
def b14(spark, d):
    return Wx.weather_ratios(daily_wx(spark, d)).select("site_id", "day", "sunshine_ratio", "clear_sky_factor", "temp_range")


P80 = "p80 AS (SELECT site_id, quantile_cont(solar_weather_score, 0.8) AS p FROM sw WHERE solar_weather_score IS NOT NULL GROUP BY 1)"
INDEX = """sunshine_hours / 12 * 0.4 + (100 - cloudcover_mean_pct) / 100 * 0.4 + CASE WHEN precipitation_mm > 1 THEN 0.5 ELSE 1.0 END * 0.2 AS weather_quality_index,
  CASE WHEN solar_weather_score > p THEN 1 ELSE 0 END AS optimal_weather_day"""


@query("b15_weather_quality_index", with_(DAILY, WX_DAILY, DAILY_WX, P80, select=f"SELECT site_id, day, {INDEX} FROM sw LEFT JOIN p80 USING (site_id)"),
       f"{KEY} weather_quality_index:f optimal_weather_day:i")
def b15(spark, d):
    return Wx.weather_quality_index(Wx.solar_weather_score(daily_wx(spark, d))).select(
        "site_id", "day", "weather_quality_index", "optimal_weather_day")


LAGGED = ("sunshine_hours", "cloudcover_mean_pct", "temp_mean_c")
LAGS = ", ".join(f"lag({c}, {k}) OVER (PARTITION BY site_id ORDER BY day) AS {c}_lag_{k}d" for c in LAGGED for k in (1, 2, 3))
LAGS_F = " ".join(f"{c}_lag_{k}d:f" for c in LAGGED for k in (1, 2, 3))
VOL = ", ".join(f"stddev_samp({c}) {over(n)} AS {c}_volatility_{n}d" for c in LAGGED for n in (3, 7))
VOL_F = " ".join(f"{c}_volatility_{n}d:f" for c in LAGGED for n in (3, 7))


@query("f9_weather_lags", with_(DAILY, WX_DAILY, DAILY_WX, select=f"SELECT site_id, day, {LAGS} FROM dw"), f"{KEY} {LAGS_F}")
def f9(spark, d):
    return Wx.weather_lags(daily_wx(spark, d)).select("site_id", "day", *names(LAGS_F))


@query("f10_weather_volatility", with_(WX_DAILY, select=f"SELECT site_id, day, {VOL} FROM wx_daily"), f"{KEY} {VOL_F}")
def f10(spark, d):
    return Wx.weather_volatility(A.weather_daily(spark, d)).select("site_id", "day", *names(VOL_F))


@query("b18_forecast_conditions", with_(WX_HOURLY, select="""
SELECT site_id, ts, cloud_cover, CASE WHEN cloud_cover < 20 THEN 'Sunny' WHEN cloud_cover < 50 THEN 'Partly Cloudy'
  WHEN cloud_cover < 80 THEN 'Cloudy' ELSE 'Overcast' END AS conditions FROM wx_hourly"""), "site_id:i ts:t cloud_cover:f conditions:s")
def b18(spark, d):
    return Wx.forecast_conditions(A.weather_hourly(spark, d)).select("site_id", "ts", "cloud_cover", "conditions")


IRR = "irr AS (SELECT site_id, CAST(ts AS DATE) AS day, sum(ghi) / 1000 AS irradiance_kwh_m2 FROM wx_hourly GROUP BY 1, 2)"


@query("b18_irradiance_conditions", with_(WX_HOURLY, IRR, select="""
SELECT *, CASE WHEN irradiance_kwh_m2 > 6 THEN 'Excellent' WHEN irradiance_kwh_m2 > 4 THEN 'Good' WHEN irradiance_kwh_m2 > 2 THEN 'Fair' ELSE 'Poor' END AS conditions FROM irr"""),
    f"{KEY} irradiance_kwh_m2:f conditions:s")
def b18_irradiance(spark, d):
    return Wx.irradiance_conditions(Wx.irradiance_daily(A.weather_hourly(spark, d)))


@query("e52_irradiance_daily", with_(WX_HOURLY, IRR, select="SELECT * FROM irr"), f"{KEY} irradiance_kwh_m2:f")
def e52(spark, d):
    return Wx.irradiance_daily(A.weather_hourly(spark, d))


NAIVE = """naive AS (SELECT *, avg(production_kwh) OVER (PARTITION BY site_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS prediction FROM daily)"""


@query("b19_outlook", with_(DAILY, NAIVE, """o AS (SELECT site_id, avg(prediction) AS forecast_avg, avg(production_kwh) AS historical_avg FROM naive GROUP BY 1)""", select="""
SELECT *, CASE WHEN forecast_avg > historical_avg * 1.1 THEN 'Excellent' WHEN forecast_avg > historical_avg * 0.9 THEN 'Good' ELSE 'Below average' END AS outlook,
  (forecast_avg / historical_avg - 1) * 100 AS difference_pct FROM o"""), "site_id:i forecast_avg:f historical_avg:f outlook:s difference_pct:f")
def b19(spark, d):
    history = daily(spark, d)
    return Wx.outlook(models.seasonal_naive(history), history, "prediction")


def correlations_sql(columns=PARAMS):
    return "r0 AS (" + " UNION ALL ".join(
        f"SELECT site_id, '{'solar_' if c in ('ghi', 'dni', 'dhi') else ''}{c}' AS parameter, corr(production_kwh, {c}) AS r FROM merged GROUP BY 1"
        for c in columns) + """),
r AS (SELECT *, CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate'
  WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Very Weak' END AS strength FROM r0 WHERE r IS NOT NULL AND NOT isnan(r))"""


@query("e41_weather_correlations", with_(MERGED, correlations_sql(), select="SELECT * FROM r"), "site_id:i parameter:s r:f strength:s")
def e41(spark, d):
    return Wx.weather_correlations(merged(spark, d))


@query("h4_top_correlations", with_(MERGED, correlations_sql(), select="""
SELECT *, CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction, row_number() OVER (PARTITION BY site_id ORDER BY abs(r) DESC, parameter) AS rank FROM r
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(r) DESC, parameter) <= 5"""), "site_id:i parameter:s r:f strength:s direction:s rank:i")
def h4(spark, d):
    return Wx.top_correlations(Wx.weather_correlations(merged(spark, d)))


def bins_sql(column, edges, labels):
    case = " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{label}'" for lo, hi, label in zip(edges[:-1], edges[1:], labels))
    return f"SELECT site_id, CASE {case} END AS bin, avg(production_kwh) AS mean_production, count(production_kwh) AS count FROM merged WHERE {column} > {edges[0]} AND {column} <= {edges[-1]} GROUP BY 1, 2"


BIN_F = "site_id:i bin:s mean_production:f count:i"


@query("e44_by_cloud_bin", with_(MERGED, select=bins_sql("cloud_cover", Wx.CLOUD_EDGES, Wx.CLOUD_LABELS)), BIN_F)
def e44(spark, d):
    return Wx.by_cloud_bin(merged(spark, d))


@query("e44_by_chart_cloud_bin", with_(MERGED, select=bins_sql("cloud_cover", Wx.CHART_CLOUD_EDGES, Wx.CHART_CLOUD_LABELS)), BIN_F)
def e44_chart(spark, d):
    return Wx.by_chart_cloud_bin(merged(spark, d))


@query("e44_clear_sky_advantage", with_(MERGED, """a AS (SELECT site_id, avg(production_kwh) FILTER (cloud_cover <= 20) AS clear_mean,
  avg(production_kwh) FILTER (cloud_cover >= 80) AS overcast_mean FROM merged GROUP BY 1)""", select="""
SELECT *, CASE WHEN overcast_mean > 0 THEN clear_mean / overcast_mean ELSE 1 END AS clear_sky_advantage FROM a"""),
    "site_id:i clear_mean:f overcast_mean:f clear_sky_advantage:f")
def e44_advantage(spark, d):
    return Wx.clear_sky_advantage(merged(spark, d))


@query("e45_by_humidity_bin", with_(MERGED, select=bins_sql("humidity", Wx.HUMIDITY_EDGES, Wx.HUMIDITY_LABELS)), BIN_F)
def e45(spark, d):
    return Wx.by_humidity_bin(merged(spark, d))


@query("e46_by_weather_condition", with_(MERGED, select="""
SELECT site_id, CASE WHEN temperature * 1.8 + 32 > 80 THEN 'Hot' ELSE 'Mild' END || ' & ' || CASE WHEN cloud_cover < 25 THEN 'Sunny' ELSE 'Cloudy' END AS condition,
  avg(production_kwh) AS mean_production, count(*) AS rows FROM merged GROUP BY 1, 2"""), "site_id:i condition:s mean_production:f rows:i")
def e46(spark, d):
    fahrenheit = merged(spark, d).withColumn("temperature", F.col("temperature") * 1.8 + 32)
    return Wx.by_weather_condition(fahrenheit)


@query("e47_seasonal_weather", with_(DAILY, WX_DAILY, DAILY_WX, select=f"""
SELECT site_id, {SEASON.format('day')} AS season, avg(production_kwh) AS avg_production, avg(temp_mean_c) AS avg_temperature, avg(cloudcover_mean_pct) AS avg_cloud_cover,
  count(*) AS rows FROM dw WHERE temp_mean_c IS NOT NULL GROUP BY 1, 2"""), "site_id:i season:s avg_production:f avg_temperature:f avg_cloud_cover:f rows:i")
def e47(spark, d):
    wx = A.weather_daily(spark, d).select("site_id", F.col("day").cast("timestamp").alias("ts"), F.col("temp_mean_c").alias("temperature"),
                                          F.col("cloudcover_mean_pct").alias("cloud_cover"))
    return Wx.seasonal_weather(merging.merge_weather_hourly(daily(spark, d), wx))


OPTIMAL = """q AS (SELECT site_id, quantile_cont(production_kwh, 0.9) AS hi, quantile_cont(production_kwh, 0.1) AS lo FROM merged WHERE production_kwh IS NOT NULL GROUP BY 1),
tagged AS (SELECT merged.*, 'optimal' AS range FROM merged JOIN q USING (site_id) WHERE production_kwh >= hi
  UNION ALL SELECT merged.*, 'suboptimal' FROM merged JOIN q USING (site_id) WHERE production_kwh <= lo)"""


def optimal_sql(columns=PARAMS):
    return " UNION ALL ".join(f"""SELECT site_id, '{c}' AS parameter, range, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.75) AS p75, avg({c}) AS mean
FROM tagged GROUP BY 1, 3""" for c in columns)


@query("e48_optimal_conditions", with_(MERGED, OPTIMAL, select=optimal_sql()), "site_id:i parameter:s range:s p25:f p75:f mean:f")
def e48(spark, d):
    return Wx.optimal_conditions(merged(spark, d))


@query("e50_weather_report", with_(MERGED, correlations_sql(), FACTORS, OPTIMAL, f"opt AS ({optimal_sql(('temperature',))})", select="""
SELECT p.site_id, start, "end", data_points, t.parameter AS top_parameter, t.r AS top_r, t.strength AS top_strength, p25 AS best_temp_low, p75 AS best_temp_high,
  mean AS best_temp_mean, average_efficiency, best_efficiency, worst_efficiency
FROM (SELECT site_id, min(ts) AS start, max(ts) AS "end", count(*) AS data_points FROM merged GROUP BY 1) p
LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY abs(r) DESC, parameter) = 1) t USING (site_id)
LEFT JOIN (SELECT * FROM opt WHERE range = 'optimal') o USING (site_id)
LEFT JOIN (SELECT site_id, avg(combined_weather_efficiency) AS average_efficiency, max(combined_weather_efficiency) AS best_efficiency,
  min(combined_weather_efficiency) AS worst_efficiency FROM factors GROUP BY 1) e USING (site_id)"""),
    'site_id:i start:t "end":t data_points:i top_parameter:s top_r:f top_strength:s best_temp_low:f best_temp_high:f best_temp_mean:f average_efficiency:f best_efficiency:f worst_efficiency:f')
def e50(spark, d):
    return reports.weather_report(merged(spark, d))


@query("e51_monthly_weather_impact", with_(DAILY, WX_DAILY, DAILY_WX, select=f"""
SELECT site_id, month(day) AS month, avg(production_kwh) AS production_kwh, avg(sunshine_hours) AS sunshine_hours, avg(cloudcover_mean_pct) AS cloudcover_mean_pct,
  avg(solar_radiation_mj) AS solar_radiation_mj, {MONTHS.format('month(day)')} AS month_name FROM dw WHERE sunshine_hours IS NOT NULL GROUP BY 1, 2, 7"""),
    "site_id:i month:i production_kwh:f sunshine_hours:f cloudcover_mean_pct:f solar_radiation_mj:f month_name:s")
def e51(spark, d):
    return Wx.monthly_weather_impact(merging.merge_weather_daily(daily(spark, d), A.weather_daily(spark, d), "inner"))


EXTREME = """SELECT site_id, '{0}' AS kind, avg(production_kwh) AS avg_production_kwh, avg(solar_weather_score) AS avg_solar_weather_score,
  avg(sunshine_hours) AS avg_sunshine_hours, avg(cloudcover_mean_pct) AS avg_cloudcover_mean_pct, avg(solar_radiation_mj) AS avg_solar_radiation_mj
FROM (SELECT * FROM sw WHERE solar_weather_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY solar_weather_score {1}, day) <= 5) t GROUP BY 1"""


@query("h1_extreme_weather_days", with_(DAILY, WX_DAILY, DAILY_WX, select=EXTREME.format("best", "DESC") + " UNION ALL " + EXTREME.format("worst", "ASC")),
       "site_id:i kind:s avg_production_kwh:f avg_solar_weather_score:f avg_sunshine_hours:f avg_cloudcover_mean_pct:f avg_solar_radiation_mj:f")
def h1(spark, d):
    return Wx.extreme_weather_days(Wx.solar_weather_score(daily_wx(spark, d)))


