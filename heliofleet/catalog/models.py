"""Splits, scores, models and anomalies. Fitted models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import distribution, merging, windows as W
from ..plans import anomalies as An, features as Fe, models as M, regression as R, reports, site_models as S, weather_model as Wm
from ..sources import adapters as A
from .base import DAILY, ENERGY, ENERGY_F, WX_DAILY, catalog, with_
from .common import daily
from .weather import NAIVE
from .windows import over

CATALOG, query = catalog()
KEY = "site_id:i day:d"


@query("g1_temporal_split", with_(DAILY, select="""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY day DESC) <= 180 THEN 1 ELSE 0 END AS is_test FROM daily"""), f"{KEY} {ENERGY_F} is_test:i")
def g1(spark, d):
    return M.temporal_split(daily(spark, d), 180)


@query("g1_share_split", with_(DAILY, select="""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY day DESC) <= ceil(count(*) OVER (PARTITION BY site_id) * 0.2) THEN 1 ELSE 0 END AS is_test FROM daily"""),
    f"{KEY} {ENERGY_F} is_test:i")
def g1_share(spark, d):
    return M.share_split(daily(spark, d), 0.2)


BASIC_FEATURES = ("day_of_year", "day_of_week", "month", "quarter", "week_of_year", "is_weekend", "is_monday", "is_winter", "is_spring", "is_summer",
                  "is_fall", "day_sin", "day_cos", "week_sin", "week_cos", "month_sin", "month_cos", "production_rolling_mean_7d", "production_rolling_std_7d",
                  "production_rolling_mean_30d", "production_rolling_std_30d", "consumption_rolling_mean_7d", "efficiency_volatility", "efficiency_cv")


def leak_safe_split(spark, d):
    rows = Fe.ml_dataset_basic(daily(spark, d), leak_safe=True)
    return M.share_split(rows.select("site_id", "day", "production_kwh", *BASIC_FEATURES))


@query("g2_compare_models")
def g2(spark, d):
    return M.compare_models(leak_safe_split(spark, d), BASIC_FEATURES)[0]


@query("g5_feature_importance")
def g5(spark, d):
    split = leak_safe_split(spark, d)
    model = M.fit(M.forest(BASIC_FEATURES), split.where("is_test = 0"))
    return M.feature_importance(model, BASIC_FEATURES, spark)


@query("h7_top_importances")
def h7(spark, d):
    return M.top_importances(g5(spark, d), 15)


@query("g3_forecaster")
def g3(spark, d):
    rows = Fe.forecast_features(daily(spark, d)).select("site_id", "day", "production_kwh", *Fe.FORECAST_COLUMNS)
    _, scored = M.train_forecaster(rows, Fe.FORECAST_COLUMNS)
    return M.regression_metrics(scored, ["site_id"])


def held_out_hours(spark, d):
    """Hourly weather with its last fifth per site flagged as the hours to forecast."""
    return M.share_split(A.weather_hourly(spark, d).withColumn("day", F.col("ts")), 0.2).drop("day")


def impact_forecast(spark, d):
    """The last fifth of each site's hours, from a forest trained on the hours before."""
    hours = held_out_hours(spark, d)
    past, ahead = (hours.where(F.col("is_test") == flag).drop("is_test") for flag in (0, 1))
    return Wm.weather_impact(A.intervals(spark, d), past, ahead)


@query("g4_weather_impact")
def g4(spark, d):
    return M.forecast_daily(impact_forecast(spark, d))


@query("g4_forecast_summary")
def g4_summary(spark, d):
    return reports.forecast_summary(impact_forecast(spark, d))


@query("e50_weather_report_with_forecast")
def e50_forecast(spark, d):
    hours = merging.merge_weather_hourly(A.intervals(spark, d), A.weather_hourly(spark, d))
    return reports.weather_report(hours, impact_forecast(spark, d))


@query("g7_weather_improvement")
def g7(spark, d):
    """300 rounds with and without weather, per site, tested on its last 180 days."""
    rows = Fe.weather_forecast_features(daily(spark, d), A.weather_daily(spark, d))
    split, model = M.temporal_split(rows), S.Ensemble("boosted", trees=300, depth=6)
    found = S.site_predictions(split, Fe.BASELINE_COLUMNS, {"baseline": model}).unionByName(
        S.site_predictions(split, Fe.WEATHER_FORECAST_COLUMNS, {"weather": model}))
    return S.improvement(found)


TWO = """s AS (SELECT site_id, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
  covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(y) AS vy FROM t{} WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s),
fitted AS (SELECT site_id, n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2, (b1 * c1 + b2 * c2) / vy AS r2 FROM b)"""


@query("g2_linear_one_feature", with_(DAILY, select="""
SELECT site_id, regr_count(production_kwh, consumption_kwh) AS n, regr_intercept(production_kwh, consumption_kwh) AS intercept,
  regr_slope(production_kwh, consumption_kwh) AS slope, regr_r2(production_kwh, consumption_kwh) AS r2 FROM daily GROUP BY 1"""),
    "site_id:i n:i intercept:f slope:f r2:f")
def g2_linear(spark, d):
    found = R.linear_models(daily(spark, d), ["consumption_kwh"])
    return found.select("site_id", "n", "intercept", found.coefficients[0].alias("slope"), "r2")


@query("g2_linear_two_features", with_(DAILY, "t AS (SELECT site_id, production_kwh AS y, consumption_kwh AS x1, export_kwh AS x2 FROM daily)",
       TWO.format(""), select="SELECT * FROM fitted"), "site_id:i n:i intercept:f b1:f b2:f r2:f")
def g2_linear_two(spark, d):
    found = R.linear_models(daily(spark, d), ["consumption_kwh", "export_kwh"])
    return found.select("site_id", "n", "intercept", found.coefficients[0].alias("b1"), found.coefficients[1].alias("b2"), "r2")


@query("g2_linear_forecast", with_(DAILY, """t0 AS (SELECT site_id, production_kwh AS y, lag(production_kwh) OVER w AS x1, lag(production_kwh, 7) OVER w AS x2,
  row_number() OVER (PARTITION BY site_id ORDER BY day DESC) <= ceil(count(*) OVER (PARTITION BY site_id) * 0.2) AS test FROM daily WINDOW w AS (PARTITION BY site_id ORDER BY day)),
t AS (SELECT * FROM t0 WHERE NOT test)""", TWO.format(""), """p AS (SELECT site_id, y, intercept + b1 * x1 + b2 * x2 AS prediction FROM t0 JOIN fitted USING (site_id) WHERE test),
m AS (SELECT site_id, count(*) AS n, avg(abs(y - prediction)) AS mae, avg((y - prediction) * (y - prediction)) AS mse, var_pop(y) AS v
  FROM p WHERE y IS NOT NULL AND prediction IS NOT NULL GROUP BY 1)""", select="""
SELECT site_id, n, mae, mse, sqrt(mse) AS rmse, CASE WHEN v > 0 THEN 1 - mse / v END AS r2 FROM m"""), "site_id:i n:i mae:f mse:f rmse:f r2:f")
def g2_linear_forecast(spark, d):
    """Yesterday and a week ago, fitted on the first four fifths of each site, tested on the last."""
    site = Window.partitionBy("site_id").orderBy("day")
    rows = daily(spark, d).withColumns({"x1": F.lag("production_kwh").over(site), "x2": F.lag("production_kwh", 7).over(site)})
    split = M.share_split(rows)
    fitted = R.linear_models(split.where("is_test = 0"), ["x1", "x2"])
    return M.regression_metrics(R.linear_predictions(split.where("is_test = 1"), fitted, ["x1", "x2"]), ["site_id"])


def site_split(spark, d):
    rows = Fe.ml_dataset_basic(daily(spark, d), leak_safe=True)
    return M.share_split(rows.select("site_id", "day", "production_kwh", *BASIC_FEATURES))


@query("g2_site_models")
def g2_sites(spark, d):
    """Linear, forest and boosted models of each site on its last fifth."""
    split = site_split(spark, d)
    trees = S.site_predictions(split, BASIC_FEATURES, {"Random Forest": S.Ensemble("forest", 100, 10), "Gradient Boosting": S.Ensemble("boosted", 100, 3)})
    fitted = R.linear_models(split.where("is_test = 0"), BASIC_FEATURES)
    linear = R.linear_predictions(split.where("is_test = 1"), fitted, BASIC_FEATURES).withColumn("model", F.lit("Linear Regression"))
    return S.compare_site_models(trees.unionByName(linear.select(trees.columns)))


@query("g3_site_forecaster")
def g3_sites(spark, d):
    rows = Fe.forecast_features(daily(spark, d)).select("site_id", "day", "production_kwh", *Fe.FORECAST_COLUMNS)
    found = S.site_predictions(M.temporal_split(rows), Fe.FORECAST_COLUMNS, {"boosted": S.Ensemble("boosted", 200, 3)})
    return M.regression_metrics(found, ["site_id"])


@query("g5_site_importances")
def g5_sites(spark, d):
    return S.site_importances(site_split(spark, d), BASIC_FEATURES, S.Ensemble("forest", 100, 10))


def naive(spark, d):
    return M.seasonal_naive(daily(spark, d))


@query("g6_regression_metrics", with_(DAILY, NAIVE, """m AS (SELECT site_id, count(*) AS n, avg(abs(production_kwh - prediction)) AS mae,
  avg((production_kwh - prediction) * (production_kwh - prediction)) AS mse, var_pop(production_kwh) AS v FROM naive WHERE prediction IS NOT NULL GROUP BY 1)""", select="""
SELECT site_id, n, mae, mse, sqrt(mse) AS rmse, CASE WHEN v > 0 THEN 1 - mse / v END AS r2 FROM m"""), "site_id:i n:i mae:f mse:f rmse:f r2:f")
def g6(spark, d):
    return M.regression_metrics(naive(spark, d), ["site_id"])


@query("g12_residuals", with_(DAILY, NAIVE, select="SELECT site_id, day, production_kwh, prediction, production_kwh - prediction AS residual FROM naive"),
       f"{KEY} production_kwh:f prediction:f residual:f")
def g12(spark, d):
    return M.residuals(naive(spark, d)).select("site_id", "day", "production_kwh", "prediction", "residual")


@query("e39_residual_histogram", with_(DAILY, NAIVE, """res AS (SELECT site_id, production_kwh - prediction AS v FROM naive WHERE prediction IS NOT NULL),
r AS (SELECT site_id, min(v) AS lo, max(v) AS hi FROM res GROUP BY 1),
b AS (SELECT site_id, least(floor((v - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM res JOIN r USING (site_id) GROUP BY 1, 2)""", select="""
SELECT s.site_id, s.bin, lo + s.bin * ((hi - lo) / 50.0) AS bin_start, lo + (s.bin + 1) * ((hi - lo) / 50.0) AS bin_end, coalesce(n, 0) AS count
FROM (SELECT site_id, lo, hi, unnest(range(50)) AS bin FROM r) s LEFT JOIN b USING (site_id, bin)"""), "site_id:i bin:i bin_start:f bin_end:f count:i")
def e39_residuals(spark, d):
    return distribution.histogram(M.residuals(naive(spark, d)), "residual", 50)


NAIVE_WX = "nw AS (SELECT n.*, w.* EXCLUDE (site_id, day) FROM naive n JOIN wx_daily w USING (site_id, day) WHERE prediction IS NOT NULL)"


def naive_wx(spark, d):
    return merging.merge_weather_daily(naive(spark, d), A.weather_daily(spark, d), "inner")


CONDITION = """SELECT site_id, '{0}' AS condition, count(*) FILTER ({1}) AS days, avg(abs(production_kwh - prediction)) FILTER ({1}) AS mae,
  count(*) FILTER ({1} AND abs(production_kwh - prediction) > 10) AS large_errors,
  CASE WHEN var_pop(production_kwh) FILTER ({1}) > 0 THEN 1 - avg((production_kwh - prediction) * (production_kwh - prediction)) FILTER ({1}) / var_pop(production_kwh) FILTER ({1}) END AS r2
FROM nw GROUP BY 1"""


@query("g8_accuracy_by_condition", with_(DAILY, NAIVE, WX_DAILY, NAIVE_WX, select=" UNION ALL ".join(CONDITION.format(n, c) for n, c in M.CONDITIONS.items())),
       "site_id:i condition:s days:i mae:f large_errors:i r2:f")
def g8(spark, d):
    return M.accuracy_by_condition(naive_wx(spark, d))


@query("g9_underperformance", with_(DAILY, NAIVE, WX_DAILY, NAIVE_WX, select="""
SELECT site_id, day, production_kwh, prediction, prediction - production_kwh AS production_gap, (prediction - production_kwh) / prediction * 100 AS production_loss_pct,
  month(day) AS month, isodow(day) - 1 AS day_of_week FROM nw WHERE prediction - production_kwh > 8"""),
    f"{KEY} production_kwh:f prediction:f production_gap:f production_loss_pct:f month:i day_of_week:i")
def g9(spark, d):
    return M.underperformance(naive_wx(spark, d)).select("site_id", "day", "production_kwh", "prediction", "production_gap", "production_loss_pct", "month", "day_of_week")


@query("g9_underperformance_patterns", with_(DAILY, NAIVE, WX_DAILY, NAIVE_WX, select="""
SELECT site_id, count(*) AS days, count(*) FILTER (g > 8) AS short_days, avg(g) FILTER (g > 8) AS avg_gap, avg(temp_mean_c) FILTER (g > 8) AS avg_temperature,
  avg(precipitation_mm) FILTER (g > 8) AS avg_precipitation, count(*) FILTER (g > 8 AND month(day) IN (12, 1, 2)) AS winter_days,
  count(*) FILTER (g > 8 AND precipitation_mm > 5) AS rainy_days, count(*) FILTER (g > 8 AND temp_mean_c > 30) AS hot_days,
  count(*) FILTER (g > 8) / count(*) * 100 AS short_pct FROM (SELECT *, prediction - production_kwh AS g FROM nw) t GROUP BY 1"""),
    "site_id:i days:i short_days:i avg_gap:f avg_temperature:f avg_precipitation:f winter_days:i rainy_days:i hot_days:i short_pct:f")
def g9_patterns(spark, d):
    return M.underperformance_patterns(naive_wx(spark, d))


ANOMALY_FEATURES = ("production_kwh", "prod_7day_avg", "seasonal_ratio", "prod_3day_std")


def scored_days(spark, d):
    df = W.seasonal_ratio(W.rolling_strict(daily(spark, d)))
    return An.anomalies(df.select("site_id", "day", *ANOMALY_FEATURES), ANOMALY_FEATURES, 0.05)


@query("g10_anomalies")
def g10(spark, d):
    return scored_days(spark, d).select("site_id", "day", "production_kwh", "anomaly_score", "is_anomaly")


@query("g10_anomaly_summary")
def g10_summary(spark, d):
    return An.anomaly_summary(scored_days(spark, d))


def site_scored_days(spark, d):
    """Tenth of each site's days, from a forest per site."""
    df = W.seasonal_ratio(W.rolling_strict(daily(spark, d)))
    return An.site_anomalies(df.select("site_id", "day", *ANOMALY_FEATURES), ANOMALY_FEATURES, 0.1)


@query("g10_site_anomalies")
def g10_sites(spark, d):
    return site_scored_days(spark, d).select("site_id", "day", "production_kwh", "anomaly_score", "is_anomaly")


@query("g10_site_anomaly_summary")
def g10_sites_summary(spark, d):
    return An.anomaly_summary(site_scored_days(spark, d))


@query("g10_score_histogram")
def g10_histogram(spark, d):
    return distribution.histogram(site_scored_days(spark, d), "anomaly_score", 50)


@query("h2_most_anomalous_days")
def h2(spark, d):
    return An.most_anomalous(scored_days(spark, d)).select("site_id", "day", "production_kwh", "anomaly_score", "rank")


@query("g11_robust_anomalies", with_(DAILY, f"""a AS (SELECT *, production_kwh / nullif(avg(production_kwh) OVER (PARTITION BY site_id, month(day)), 0) AS seasonal_ratio,
  production_kwh - median(production_kwh) {over(7)} AS deviation FROM daily),
q AS (SELECT site_id, quantile_cont(deviation, 0.25) AS d1, quantile_cont(deviation, 0.75) AS d3, quantile_cont(seasonal_ratio, 0.25) AS s1,
  quantile_cont(seasonal_ratio, 0.75) AS s3 FROM a GROUP BY 1),
f AS (SELECT a.site_id, day, deviation, seasonal_ratio,
  CASE WHEN deviation < d1 - (d3 - d1) * 1.5 OR deviation > d3 + (d3 - d1) * 1.5 THEN 1 ELSE 0 END AS far_from_median,
  CASE WHEN seasonal_ratio < s1 - (s3 - s1) * 1.5 OR seasonal_ratio > s3 + (s3 - s1) * 1.5 THEN 1 ELSE 0 END AS off_season FROM a JOIN q USING (site_id))""", select="""
SELECT *, greatest(far_from_median, off_season) AS is_anomaly FROM f"""),
    f"{KEY} deviation:f seasonal_ratio:f far_from_median:i off_season:i is_anomaly:i")
def g11(spark, d):
    return An.robust_anomalies(daily(spark, d)).drop(*ENERGY)


