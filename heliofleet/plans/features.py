"""Feature sets for forecasting.

A set is one lazy chain. All its windows partition by site, so the daily table is sorted
once per site whatever the number of columns; site dimensions are joined on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators import finance, location, merging, metrics, selection, weather, windows
from ..schema import CONSUMPTION, DAY, ENERGY, EXPORT, PRODUCTION, SITE, WEATHER_DAILY

TEMPORAL_SETS = ("time", "cyclical", "rolling", "lag")
FEATURE_SETS = ("temporal", "location", "financial", "weather")

SAME_DAY = ("net_energy_kwh", "energy_surplus", "self_sufficiency_pct", "self_consumed_kwh",
            "self_consumption_rate_pct", "grid_independence_pct")


def ml_dataset_basic(daily: DataFrame, time=True, rolling=True, efficiency=True, clean=True,
                     leak_safe=False) -> DataFrame:
    """Metrics, calendar, rolling and efficiency columns in one set.

    ``leak_safe`` keeps the target of a day out of its own features: rolling columns end on
    the day before and functions of the same day are dropped.
    """
    df, raw = daily, set(daily.columns)
    if {PRODUCTION, CONSUMPTION} <= raw:
        df = metrics.net_energy(df)
    if {PRODUCTION, CONSUMPTION, EXPORT} <= raw:
        df = metrics.self_consumption(df)
    if time:
        df = df.withColumns({**cal.time_feature_columns(DAY),
                             **cal.cyclical_columns(DAY, ("day", "week", "month"))})
    before = list(df.columns)
    if rolling:
        df = windows.rolling_stats(df, [c for c in ENERGY if c in raw])
    if efficiency:
        df = windows.efficiency_metrics(df)
    if leak_safe:
        late = [c for c in df.columns if c not in before]
        df = df.withColumns({c: F.lag(c).over(windows.by_day()) for c in late}).drop(*SAME_DAY)
    return selection.drop_incomplete(df) if clean else df


def temporal_features(daily: DataFrame, sets=TEMPORAL_SETS, target=PRODUCTION) -> DataFrame:
    columns = {}
    if "time" in sets:
        columns.update(cal.time_feature_columns(DAY))
    if "cyclical" in sets:
        columns.update(cal.cyclical_columns(DAY))
    if "time" in sets:
        columns.update(cal.solstice_columns(DAY))
    if "lag" in sets:
        columns.update(windows.lag_columns(target))
    if "rolling" in sets:
        df = windows.temporal_rolling(daily, target, extra=columns)
        df = windows.volatility_trend(df, target)
    else:
        columns["production_volatility"] = F.stddev_samp(target).over(windows.trailing(7))
        df = daily.withColumns(columns)
    return df.withColumns(windows.change_columns(target)) if "lag" in sets else df


def weather_columns(df: DataFrame) -> DataFrame:
    """Weather features of rows that already carry daily weather."""
    df = weather.solar_weather_score(weather.weather_ratios(df))
    df = weather.weather_quality_index(df)
    return weather.weather_volatility(weather.weather_lags(df))


def weather_features(daily: DataFrame, wx: DataFrame, keep_weather=False) -> DataFrame:
    df = weather_columns(merging.merge_weather_daily(daily, wx))
    return df if keep_weather else df.drop(*WEATHER_DAILY)


def location_features(daily: DataFrame, sites: DataFrame) -> DataFrame:
    df = location.location_efficiency(location.enrich_daily(daily, sites))
    return location.theoretical_features(df)


def financial_features(daily: DataFrame, tariffs: DataFrame, costs: DataFrame) -> DataFrame:
    df = finance.economic_constants(daily, tariffs, costs)
    df = windows.daily_performance(df)
    df = finance.financial_daily(df, tariffs)
    df = finance.opportunity(finance.financial_rolling(df))
    return df.drop("purchase_rate", "feed_in_rate")


def feature_set(daily: DataFrame, sets=("temporal", "location", "financial"), sites=None,
                tariffs=None, costs=None, wx=None, clean="dropna") -> DataFrame:
    """Temporal, location, financial and weather features, then cleaning.

    Weather is joined on (site, day) first, before the shuffle on site that all windows share.
    """
    unknown = set(sets) - set(FEATURE_SETS)
    if unknown:
        raise ValueError(f"unknown feature sets: {sorted(unknown)}")
    needed = {"location": (sites,), "financial": (tariffs, costs), "weather": (wx,)}
    for name in sets:
        if any(x is None for x in needed.get(name, ())):
            raise ValueError(f"the {name} set needs its dimension tables")
    df = merging.merge_weather_daily(daily, wx) if "weather" in sets else daily
    if "temporal" in sets:
        df = temporal_features(df)
    if "location" in sets:
        df = location_features(df, sites)
    if "financial" in sets:
        df = financial_features(df, tariffs, costs)
    if "weather" in sets:
        df = weather_columns(df).drop(*WEATHER_DAILY)
    if clean == "dropna":
        return selection.drop_incomplete(df)
    return selection.fill_missing(df) if clean == "fillna" else df


def features_by_category(daily, sites=None, tariffs=None, costs=None, wx=None):
    """Name of the set -> keys and the columns it adds."""
    out = {"temporal": temporal_features(daily)}
    if sites is not None:
        out["location"] = location_features(daily, sites)
    if tariffs is not None and costs is not None:
        out["financial"] = financial_features(daily, tariffs, costs)
    if wx is not None:
        out["weather"] = weather_features(daily, wx)
    return {name: selection.new_columns(daily, df) for name, df in out.items()}


FORECAST_COLUMNS = ("month", "day_of_year", "day_of_week", "quarter", "prod_yesterday",
                    "prod_2days_ago", "prod_week_ago", "prod_3day_std", "prod_7day_avg")
WEATHER_FORECAST_COLUMNS = (
    "month", "day_of_year", "day_of_week", "quarter", "prod_yesterday", "prod_2days_ago",
    "prod_7day_avg", "sunshine_hours", "solar_radiation_mj", "cloudcover_mean_pct",
    "temp_mean_c", "temp_range", "solar_weather_score", "clear_sky_factor", "sunshine_ratio",
    "precipitation_mm")
BASELINE_COLUMNS = WEATHER_FORECAST_COLUMNS[:7]


def _forecast_columns(target):
    parts = cal.time_feature_columns(DAY)
    w = windows.by_day()
    return {
        **{n: parts[n] for n in ("month", "day_of_year", "day_of_week", "quarter")},
        "prod_yesterday": F.lag(target, 1).over(w), "prod_2days_ago": F.lag(target, 2).over(w),
        "prod_week_ago": F.lag(target, 7).over(w),
        "prod_3day_std": windows.strict(F.stddev_samp, target, 3),
        "prod_7day_avg": windows.strict(F.avg, target, 7)}


def forecast_features(daily: DataFrame, target=PRODUCTION) -> DataFrame:
    return selection.drop_incomplete(daily.withColumns(_forecast_columns(target)))


def weather_forecast_features(daily: DataFrame, wx: DataFrame, target=PRODUCTION) -> DataFrame:
    """The 16 model columns over the days that have weather; lags count joined rows."""
    merged = merging.merge_weather_daily(daily.select(SITE, DAY, target), wx, "inner")
    df = weather.solar_weather_score(weather.weather_ratios(merged))
    df = df.withColumns({k: c for k, c in _forecast_columns(target).items()
                         if k not in ("prod_week_ago", "prod_3day_std")})
    return selection.drop_incomplete(df.select(SITE, DAY, target, *WEATHER_FORECAST_COLUMNS))
