"""Feature sets."""

from __future__ import annotations

from ..plans import features as Fe
from ..sources import adapters as A
from .base import DAILY, ENERGY, ENERGY_F, WX_DAILY, catalog, with_
from .common import daily, tariffs
from .finance import ANNUAL, BENEFITS, COSTS, ECON, ECON_F, FIN_DAILY, FIN_F, OPP, P95, ROI, ROLL, ROLL_F
from .joins import SITES, TARIFFS
from .projections import (CYCLES, NET, NET_F, SELF, SELF_F, SOLSTICE, TIME, TIME_F, cycle_f, cycle_sql)
from .solar import B16, B16_F, B17, B17_F, DAILY_GEO, GEO, GEO_F
from .weather import DAILY_WX, INDEX, LAGS, LAGS_F, P80, VOL, VOL_F
from .windows import EFFICIENCY, EFFICIENCY_F, LAG_F, TREND, TREND_F, VOLATILITY, lag_sql, rolling_f, rolling_sql, strict, temporal_f, temporal_sql

CATALOG, query = catalog()
KEY = "site_id:i day:d"


def names(kinds):
    return [k.split(":")[0] for k in kinds.split()]


def complete(sql, kinds):
    """Rows without a NULL."""
    return f"SELECT * FROM ({sql}) x WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names(kinds))


K1_F = f"{KEY} {ENERGY_F} {NET_F} {SELF_F} {TIME_F} {cycle_f(CYCLES[:3])} {rolling_f()} {EFFICIENCY_F}"
K1 = f"SELECT *, {NET}, {SELF}, {TIME}, {cycle_sql(CYCLES[:3])}, {rolling_sql()}, {EFFICIENCY} FROM daily"


@query("k1_ml_dataset_basic", with_(DAILY, select=complete(K1, K1_F)), K1_F)
def k1(spark, d):
    return Fe.ml_dataset_basic(daily(spark, d))


@query("k1_ml_dataset_leak_safe", with_(DAILY, select=complete(f"""
SELECT site_id, day, production_kwh, consumption_kwh, export_kwh, import_kwh, {TIME}, {cycle_sql(CYCLES[:3])}, """ + ", ".join(
    f"lag({n}) OVER (PARTITION BY site_id ORDER BY day) AS {n}" for n in names(rolling_f() + " " + EFFICIENCY_F)) + f" FROM ({K1}) k",
    f"{KEY} {ENERGY_F} {rolling_f()} {EFFICIENCY_F}")), f"{KEY} {ENERGY_F} {TIME_F} {cycle_f(CYCLES[:3])} {rolling_f()} {EFFICIENCY_F}")
def k1_safe(spark, d):
    return Fe.ml_dataset_basic(daily(spark, d), leak_safe=True)


TEMPORAL = f"{TIME}, {cycle_sql(CYCLES)}, {SOLSTICE}, {temporal_sql()}, {lag_sql()}, {TREND}"
TEMPORAL_F = f"{TIME_F} {cycle_f(CYCLES)} days_from_summer_solstice:i seasonal_strength:f {temporal_f()} {LAG_F} {TREND_F}"


@query("k2_temporal_features", with_(DAILY, VOLATILITY, select=f"SELECT site_id, day, {TEMPORAL} FROM vol"), f"{KEY} {TEMPORAL_F}")
def k2(spark, d):
    return Fe.temporal_features(daily(spark, d)).select("site_id", "day", *names(TEMPORAL_F))


RATIOS = "sunshine_hours / 12 AS sunshine_ratio, 100 - cloudcover_mean_pct AS clear_sky_factor, temp_max_c - temp_min_c AS temp_range"
WEATHER = f"{RATIOS}, solar_weather_score, {INDEX}, {LAGS}, {VOL}"
WEATHER_F = f"sunshine_ratio:f clear_sky_factor:f temp_range:f solar_weather_score:f weather_quality_index:f optimal_weather_day:i {LAGS_F} {VOL_F}"


@query("k3_weather_features", with_(DAILY, WX_DAILY, DAILY_WX, P80, select=f"SELECT site_id, day, {WEATHER} FROM sw LEFT JOIN p80 USING (site_id)"), f"{KEY} {WEATHER_F}")
def k3(spark, d):
    return Fe.weather_features(daily(spark, d), A.weather_daily(spark, d)).drop(*ENERGY)


LOCATION_F = f"{GEO_F} {B16_F} {B17_F}"


@query("k4_location_features", with_(DAILY, SITES, DAILY_GEO, select=f"SELECT site_id, day, {GEO}, {B16}, {B17} FROM d1"), f"{KEY} {LOCATION_F}")
def k4(spark, d):
    return Fe.location_features(daily(spark, d), A.sites(spark, d)).drop(*ENERGY)


FIN_CTES = (TARIFFS, ANNUAL, BENEFITS, COSTS, ROI, ECON, FIN_DAILY, P95, f"""ff AS (SELECT site_id, day, e.* EXCLUDE (site_id),
  production_kwh / nullif(daily_average_kwh, 0) AS daily_performance_ratio, production_kwh / nullif(daily_average_kwh, 0) * e.capacity_factor AS efficiency_normalized,
  daily_export_value, daily_import_savings, daily_total_savings, financial_efficiency, f.savings_rate, {ROLL}, {OPP}
  FROM fin f JOIN econ e USING (site_id) JOIN annual a USING (site_id) JOIN p95 USING (site_id))""")
FINANCIAL_F = f"{ECON_F} daily_performance_ratio:f efficiency_normalized:f {FIN_F} {ROLL_F} daily_financial_opportunity:f opportunity_ratio:f"


@query("k5_financial_features", with_(DAILY, *FIN_CTES, select="SELECT * FROM ff"), f"{KEY} {FINANCIAL_F}", 4)
def k5(spark, d):
    return Fe.financial_features(daily(spark, d), tariffs(spark, d), A.site_finance(spark, d)).drop(*ENERGY)


K6_F = f"{KEY} {ENERGY_F} {TEMPORAL_F} {LOCATION_F} {FINANCIAL_F} {WEATHER_F}"
K6_CTES = (DAILY, VOLATILITY, SITES, DAILY_GEO, *[c.replace(SITES + ",\n", "") for c in FIN_CTES], WX_DAILY, DAILY_WX, P80,
           f"tf AS (SELECT site_id, day, production_kwh, consumption_kwh, export_kwh, import_kwh, {TEMPORAL} FROM vol)",
           f"lf AS (SELECT site_id, day, {GEO}, {B16}, {B17} FROM d1)",
           f"wf AS (SELECT site_id, day, {WEATHER} FROM sw LEFT JOIN p80 USING (site_id))",
           "allf AS (SELECT * FROM tf JOIN lf USING (site_id, day) JOIN ff USING (site_id, day) JOIN wf USING (site_id, day))")


def full_set(spark, d, clean):
    return Fe.feature_set(daily(spark, d), Fe.FEATURE_SETS, A.sites(spark, d), tariffs(spark, d), A.site_finance(spark, d),
                          A.weather_daily(spark, d), clean)


@query("k6_feature_set", with_(*K6_CTES, select="SELECT * FROM allf"), K6_F, 4)
def k6(spark, d):
    return full_set(spark, d, "none")


@query("k6_feature_set_complete", with_(*K6_CTES, select=complete("SELECT * FROM allf", K6_F)), K6_F, 4)
def k6_complete(spark, d):
    return full_set(spark, d, "dropna")


K7_PARTS = f"""month(day) AS month, dayofyear(day) AS day_of_year, isodow(day) - 1 AS day_of_week, quarter(day) AS quarter,
  lag(production_kwh, 1) OVER (PARTITION BY site_id ORDER BY day) AS prod_yesterday, lag(production_kwh, 2) OVER (PARTITION BY site_id ORDER BY day) AS prod_2days_ago"""
K7 = f"""SELECT *, {K7_PARTS}, lag(production_kwh, 7) OVER (PARTITION BY site_id ORDER BY day) AS prod_week_ago,
  {strict('stddev_samp', 'production_kwh', 3)} AS prod_3day_std, {strict('avg', 'production_kwh', 7)} AS prod_7day_avg FROM daily"""
K7_F = (f"{KEY} {ENERGY_F} month:i day_of_year:i day_of_week:i quarter:i prod_yesterday:f prod_2days_ago:f prod_week_ago:f prod_3day_std:f prod_7day_avg:f")


@query("k7_forecast_features", with_(DAILY, select=complete(K7, K7_F)), K7_F)
def k7(spark, d):
    return Fe.forecast_features(daily(spark, d))


K8 = f"""SELECT site_id, day, production_kwh, {K7_PARTS}, {strict('avg', 'production_kwh', 7)} AS prod_7day_avg, sunshine_hours, solar_radiation_mj,
  cloudcover_mean_pct, temp_mean_c, temp_max_c - temp_min_c AS temp_range, solar_weather_score, 100 - cloudcover_mean_pct AS clear_sky_factor,
  sunshine_hours / 12 AS sunshine_ratio, precipitation_mm FROM (SELECT * FROM sw WHERE sunshine_hours IS NOT NULL) j"""
K8_F = (f"{KEY} production_kwh:f month:i day_of_year:i day_of_week:i quarter:i prod_yesterday:f prod_2days_ago:f prod_7day_avg:f sunshine_hours:f solar_radiation_mj:f "
        "cloudcover_mean_pct:f temp_mean_c:f temp_range:f solar_weather_score:f clear_sky_factor:f sunshine_ratio:f precipitation_mm:f")


@query("k8_weather_forecast_features", with_(DAILY, WX_DAILY, DAILY_WX, select=complete(K8, K8_F)), K8_F)
def k8(spark, d):
    return Fe.weather_forecast_features(daily(spark, d), A.weather_daily(spark, d))


