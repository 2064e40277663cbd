"""Rolling, lagged and seasonal columns, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, windows as W
from .base import DAILY, ENERGY, ENERGY_F, catalog, with_
from .common import daily
from .projections import NET, NET_F

CATALOG, query = catalog()
KEY = "site_id:i day:d"
P = "production_kwh"
ORD = "PARTITION BY site_id ORDER BY day"


def over(n):
    return f"OVER ({ORD} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@query("rolling_daily", with_(DAILY, select=f"""
SELECT *, {NET}, avg({P}) {over(7)} AS rolling_mean_7d, stddev_samp({P}) {over(7)} AS rolling_std_7d,
  median({P}) {over(7)} AS rolling_median_7d, lag({P}, 7) OVER ({ORD}) AS {P}_lag_7d FROM daily"""),
    f"{KEY} {ENERGY_F} {NET_F} rolling_mean_7d:f rolling_std_7d:f rolling_median_7d:f {P}_lag_7d:f")
def rolling_daily(spark, d):
    """Adapter, gap fill, daily sums, net energy, rolling mean, deviation and median, lag."""
    df = metrics.net_energy(daily(spark, d))
    week = W.trailing(7)
    return df.withColumns({
        "rolling_mean_7d": F.avg(P).over(week), "rolling_std_7d": F.stddev_samp(P).over(week),
        "rolling_median_7d": W.rolling_median(P, 7), **W.lag_columns(steps=(7,))})


def rolling_sql(cols=ENERGY, stats=("mean", "std"), ns=(7, 14, 30)):
    return ", ".join(f"{FN[s]}({c}) {over(n)} AS {c.removesuffix('_kwh')}_rolling_{s}_{n}d"
                     for c in cols for n in ns for s in stats)


def rolling_f(cols=ENERGY, stats=("mean", "std"), ns=(7, 14, 30)):
    return " ".join(f"{c.removesuffix('_kwh')}_rolling_{s}_{n}d:f" for c in cols for n in ns for s in stats)


ALL = ("mean", "std", "min", "max")


@query("f2_rolling_stats", with_(DAILY, select=f"SELECT site_id, day, {rolling_sql(stats=ALL)} FROM daily"),
       f"{KEY} {rolling_f(stats=ALL)}")
def f2(spark, d):
    return W.rolling_stats(daily(spark, d), stats=ALL).drop(*ENERGY)


def temporal_sql(ns=(7, 14, 30)):
    return ", ".join(f"""avg({P}) {over(n)} AS rolling_mean_{n}d, stddev_samp({P}) {over(n)} AS rolling_std_{n}d,
  median({P}) {over(n)} AS rolling_median_{n}d, min({P}) {over(n)} AS rolling_min_{n}d, max({P}) {over(n)} AS rolling_max_{n}d,
  max({P}) {over(n)} - min({P}) {over(n)} AS rolling_range_{n}d""" for n in ns)


def temporal_f(ns=(7, 14, 30)):
    return " ".join(f"rolling_{s}_{n}d:f" for n in ns for s in ("mean", "std", "median", "min", "max", "range"))


@query("f3_temporal_rolling", with_(DAILY, select=f"SELECT site_id, day, {temporal_sql()} FROM daily"),
       f"{KEY} {temporal_f()}")
def f3(spark, d):
    return W.temporal_rolling(daily(spark, d)).drop(*ENERGY)


def strict(fn, c, n):
    return f"CASE WHEN count({c}) {over(n)} = {n} THEN {fn}({c}) {over(n)} END"


@query("f4_rolling_strict", with_(DAILY, select=f"""
SELECT site_id, day, {strict('avg', P, 7)} AS prod_7day_avg, {strict('avg', P, 30)} AS prod_30day_avg,
  {strict('stddev_samp', P, 3)} AS prod_3day_std, {strict('max', P, 7)} AS prod_7day_max, {strict('min', P, 7)} AS prod_7day_min,
  {strict('avg', 'consumption_kwh', 7)} AS cons_7day_avg FROM daily"""),
    f"{KEY} prod_7day_avg:f prod_30day_avg:f prod_3day_std:f prod_7day_max:f prod_7day_min:f cons_7day_avg:f")
def f4(spark, d):
    return W.rolling_strict(daily(spark, d)).drop(*ENERGY)


def centered(back, ahead, n):
    o = f"OVER ({ORD} ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
    return f"CASE WHEN count({P}) {o} = {n} THEN avg({P}) {o} END AS centered_mean_{n}d"


@query("f5_rolling_centered", with_(DAILY, select=f"SELECT site_id, day, {centered(3, 3, 7)}, {centered(15, 14, 30)} FROM daily"),
       f"{KEY} centered_mean_7d:f centered_mean_30d:f")
def f5(spark, d):
    return W.rolling_centered(daily(spark, d)).drop(*ENERGY)


def lag_sql(lags=(1, 2, 3, 7, 14), changes=(1, 7)):
    out = [f"lag({P}, {k}) OVER ({ORD}) AS {P}_lag_{k}d" for k in lags]
    for k in changes:
        before = f"lag({P}, {k}) OVER ({ORD})"
        out += [f"{P} - {before} AS change_from_{k}d_ago",
                f"({P} - {before}) / ({before} + 0.01) * 100 AS pct_change_from_{k}d_ago"]
    return ", ".join(out)


LAG_F = " ".join([f"{P}_lag_{k}d:f" for k in (1, 2, 3, 7, 14)]
                 + [f"change_from_{k}d_ago:f pct_change_from_{k}d_ago:f" for k in (1, 7)])


@query("f6_lags", with_(DAILY, select=f"SELECT site_id, day, {lag_sql()} FROM daily"), f"{KEY} {LAG_F}")
def f6(spark, d):
    return W.lags(daily(spark, d)).drop(*ENERGY)


VOLATILITY = f"""vol AS (SELECT *, avg({P}) {over(7)} AS m7, avg({P}) {over(30)} AS m30, stddev_samp({P}) {over(7)} AS production_volatility FROM daily)"""
TREND = f"""production_volatility, {P} / (m30 + 0.01) AS relative_performance,
  (m7 - lag(m7, 7) OVER ({ORD})) / (lag(m7, 7) OVER ({ORD}) + 0.01) AS trend_7d,
  (m30 - lag(m30, 30) OVER ({ORD})) / (lag(m30, 30) OVER ({ORD}) + 0.01) AS trend_30d"""
TREND_F = "production_volatility:f relative_performance:f trend_7d:f trend_30d:f"


@query("f7_volatility_trend", with_(DAILY, VOLATILITY, select=f"SELECT site_id, day, {TREND}, m7 AS rolling_mean_7d, m30 AS rolling_mean_30d FROM vol"),
       f"{KEY} {TREND_F} rolling_mean_7d:f rolling_mean_30d:f")
def f7(spark, d):
    return W.volatility_trend(daily(spark, d)).drop(*ENERGY)


EFFICIENCY = f"""CASE WHEN avg({P}) {over(30)} = 0 THEN 1.0 ELSE {P} / avg({P}) {over(30)} END AS efficiency_relative_performance,
  stddev_samp({P}) {over(7)} AS efficiency_volatility,
  CASE WHEN avg({P}) {over(30)} = 0 THEN 0.0 ELSE stddev_samp({P}) {over(7)} / avg({P}) {over(30)} END AS efficiency_cv"""
EFFICIENCY_F = "efficiency_relative_performance:f efficiency_volatility:f efficiency_cv:f"


@query("f8_efficiency_metrics", with_(DAILY, select=f"SELECT site_id, day, {EFFICIENCY} FROM daily"), f"{KEY} {EFFICIENCY_F}")
def f8(spark, d):
    return W.efficiency_metrics(daily(spark, d)).drop(*ENERGY)


@query("f13_seasonal_ratio", with_(DAILY, select=f"""
SELECT site_id, day, {P} / nullif(avg({P}) OVER (PARTITION BY site_id, month(day)), 0) AS seasonal_ratio FROM daily"""),
    f"{KEY} seasonal_ratio:f")
def f13(spark, d):
    return W.seasonal_ratio(daily(spark, d)).drop(*ENERGY)


@query("f15_daily_performance", with_(DAILY, select=f"""
SELECT site_id, day, {P} / nullif(avg({P}) OVER (PARTITION BY site_id), 0) AS daily_performance_ratio FROM daily"""),
    f"{KEY} daily_performance_ratio:f")
def f15(spark, d):
    return W.daily_performance(daily(spark, d)).drop(*ENERGY)
