"""Weather impact on production."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.numeric import ascending_band, at_most, clip, ratio, right_closed_bin
from ..schema import DAY, PRODUCTION, SITE, TS
from .distribution import correlations_with
from .windows import by_day, trailing

BASIC = ("temperature", "humidity", "cloud_cover", "wind_speed", "pressure")
SOLAR = ("ghi", "dni", "dhi")
LAGGED = ("sunshine_hours", "cloudcover_mean_pct", "temp_mean_c")

# Bins and their names.
CLOUD_EDGES = (0, 20, 40, 60, 80, 100)
CLOUD_LABELS = ("Clear (0-20%)", "Partly Cloudy (20-40%)", "Cloudy (40-60%)",
                "Very Cloudy (60-80%)", "Overcast (80-100%)")
CHART_CLOUD_EDGES = (0, 25, 50, 75, 100)
CHART_CLOUD_LABELS = ("Clear", "Partly Cloudy", "Cloudy", "Overcast")
HUMIDITY_EDGES = (0, 40, 60, 80, 100)
HUMIDITY_LABELS = ("Low", "Medium", "High", "Very High")
SKY_LIMITS, SKY_LABELS = (20, 50, 80), ("Sunny", "Partly Cloudy", "Cloudy", "Overcast")


def weather_factors(df: DataFrame) -> DataFrame:
    """Efficiency, cloud, humidity and wind factor and their product (0..2).

    A site with any irradiance uses it as the baseline, else a temperature model.
    """
    has_ghi = F.max(F.col("ghi").isNotNull()).over(Window.partitionBy(SITE))
    by_sun = clip(ratio(PRODUCTION, F.col("ghi") * F.lit(0.15)), 0, 2)
    # a positive value over no irradiance is unbounded and takes the cap
    by_sun = F.when((F.col("ghi") == 0) & (F.col(PRODUCTION) > 0), F.lit(2.0)).otherwise(by_sun)
    by_heat = clip(F.lit(1.0) - F.abs(F.col("temperature") - F.lit(25.0)) * F.lit(0.004), 0.5, 1.2)
    df = df.withColumns({
        "efficiency_factor": F.when(has_ghi, by_sun).otherwise(by_heat),
        "cloud_factor": F.lit(1.0) - F.col("cloud_cover") / F.lit(100.0) * F.lit(0.8),
        "humidity_factor": F.lit(1.0) - F.col("humidity") / F.lit(100.0) * F.lit(0.1),
        "wind_factor": at_most(F.lit(1.0) + F.col("wind_speed") * F.lit(0.02), 1.2)})
    product = (F.col("efficiency_factor") * F.col("cloud_factor") * F.col("humidity_factor")
               * F.col("wind_factor"))
    return df.withColumn("combined_weather_efficiency", clip(product, 0, 2))


def efficiency_summary(factors: DataFrame) -> DataFrame:
    c = "combined_weather_efficiency"
    return factors.groupBy(SITE).agg(F.avg(c).alias("average_efficiency"),
                                     F.max(c).alias("best_efficiency"),
                                     F.min(c).alias("worst_efficiency"))


def solar_weather_score(df: DataFrame) -> DataFrame:
    """50 + 40 sun - 30 cloud +- 10 temperature - 20 rain, in 0..100."""
    sun = clip(F.col("sunshine_hours") / F.lit(12.0), 0, 1) * F.lit(40.0)
    cloud = F.col("cloudcover_mean_pct") / F.lit(100.0) * F.lit(30.0)
    heat = clip(F.lit(1.0) - F.abs(F.col("temp_mean_c") - F.lit(25.0)) / F.lit(25.0), -1, 1)
    rain = F.when(F.col("precipitation_mm") > 1, F.lit(20.0)).otherwise(F.lit(0.0))
    score = F.lit(50.0) + sun - cloud + heat * F.lit(10.0) - rain
    return df.withColumn("solar_weather_score", clip(score, 0, 100))


def weather_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sunshine_ratio": F.col("sunshine_hours") / F.lit(12.0),
        "clear_sky_factor": F.lit(100.0) - F.col("cloudcover_mean_pct"),
        "temp_range": F.col("temp_max_c") - F.col("temp_min_c")})


def weather_quality_index(df: DataFrame) -> DataFrame:
    """0.4 sun + 0.4 clear sky + 0.2 dryness, and the flag of scores above the site's p80."""
    dry = F.when(F.col("precipitation_mm") > 1, F.lit(0.5)).otherwise(F.lit(1.0))
    index = (F.col("sunshine_hours") / F.lit(12.0) * F.lit(0.4)
             + (F.lit(100.0) - F.col("cloudcover_mean_pct")) / F.lit(100.0) * F.lit(0.4)
             + dry * F.lit(0.2))
    p80 = F.percentile("solar_weather_score", F.lit(0.8)).over(Window.partitionBy(SITE))
    best = F.coalesce(F.col("solar_weather_score") > p80, F.lit(False))
    return df.withColumns({"weather_quality_index": index, "optimal_weather_day": best.cast("int")})


def weather_lags(df: DataFrame, cols=LAGGED, lags=(1, 2, 3)) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}d": F.lag(c, k).over(by_day()) for c in cols for k in lags})


def weather_volatility(df: DataFrame, cols=LAGGED, windows=(3, 7)) -> DataFrame:
    return df.withColumns({f"{c}_volatility_{n}d": F.stddev_samp(c).over(trailing(n))
                           for c in cols for n in windows})


def forecast_conditions(forecast: DataFrame) -> DataFrame:
    """Sky name by cloud cover (20 / 50 / 80 %)."""
    return forecast.withColumn("conditions", ascending_band("cloud_cover", SKY_LIMITS, SKY_LABELS))


def irradiance_conditions(daily: DataFrame) -> DataFrame:
    """Rating by kWh/m2 of a day (above 6 / 4 / 2)."""
    v = F.col("irradiance_kwh_m2")
    rating = (F.when(v > 6, "Excellent").when(v > 4, "Good").when(v > 2, "Fair").otherwise("Poor"))
    return daily.withColumn("conditions", F.when(v.isNotNull(), rating))


def irradiance_daily(weather: DataFrame) -> DataFrame:
    return weather.groupBy(SITE, F.to_date(TS).alias(DAY)).agg(
        (F.coalesce(F.sum("ghi"), F.lit(0.0)) / F.lit(1000.0)).alias("irradiance_kwh_m2"))


def outlook(forecast: DataFrame, history: DataFrame, value="predicted_production") -> DataFrame:
    """Forecast mean against the historical mean (above 1.1, above 0.9, below)."""
    ahead = forecast.groupBy(SITE).agg(F.avg(value).alias("forecast_avg"))
    past = history.groupBy(SITE).agg(F.avg(PRODUCTION).alias("historical_avg"))
    f, h = F.col("forecast_avg"), F.col("historical_avg")
    verdict = (F.when(f > h * F.lit(1.1), "Excellent").when(f > h * F.lit(0.9), "Good")
               .otherwise("Below average"))
    return ahead.join(past, SITE).withColumns({
        "outlook": verdict, "difference_pct": (ratio(f, h) - F.lit(1.0)) * F.lit(100.0)})


def weather_correlations(merged: DataFrame) -> DataFrame:
    """r of production with the basic columns and ``solar_``-prefixed irradiance."""
    out = correlations_with(merged, [c for c in (*BASIC, *SOLAR) if c in merged.columns])
    name = F.col("parameter")
    return out.withColumn("parameter", F.when(name.isin(*SOLAR), F.concat(F.lit("solar_"), name))
                          .otherwise(name))


def top_correlations(correlations: DataFrame, n=5) -> DataFrame:
    """Strongest correlations of each site by absolute r."""
    place = F.row_number().over(Window.partitionBy(SITE).orderBy(
        F.abs("r").desc(), "parameter"))
    direction = F.when(F.col("r") > 0, "Positive").otherwise("Negative")
    return correlations.withColumns({"rank": place, "direction": direction}).where(
        F.col("rank") <= n)


def _by_bin(merged, column, edges, labels, include_lowest):
    label = right_closed_bin(column, edges, labels, include_lowest)
    return (merged.withColumn("bin", label).where(F.col("bin").isNotNull()).groupBy(SITE, "bin")
            .agg(F.avg(PRODUCTION).alias("mean_production"), F.count(PRODUCTION).alias("count")))


def by_cloud_bin(merged: DataFrame, edges=CLOUD_EDGES, labels=CLOUD_LABELS, include_lowest=False):
    """Production by right-closed cloud bins; cover of exactly 0 is in none by default."""
    return _by_bin(merged, "cloud_cover", edges, labels, include_lowest)


def by_chart_cloud_bin(merged: DataFrame) -> DataFrame:
    return _by_bin(merged, "cloud_cover", CHART_CLOUD_EDGES, CHART_CLOUD_LABELS, False)


def by_humidity_bin(merged: DataFrame) -> DataFrame:
    return _by_bin(merged, "humidity", HUMIDITY_EDGES, HUMIDITY_LABELS, False)


def clear_sky_advantage(merged: DataFrame) -> DataFrame:
    """Mean production under clear sky (<= 20) over overcast (>= 80), 1 without overcast."""
    clear = F.avg(F.when(F.col("cloud_cover") <= 20, F.col(PRODUCTION)))
    dark = F.avg(F.when(F.col("cloud_cover") >= 80, F.col(PRODUCTION)))
    out = merged.groupBy(SITE).agg(clear.alias("clear_mean"), dark.alias("overcast_mean"))
    return out.withColumn("clear_sky_advantage", F.when(
        F.col("overcast_mean") > 0, ratio("clear_mean", "overcast_mean")).otherwise(F.lit(1.0)))


def by_weather_condition(merged: DataFrame, hot=80.0, cloudy=25.0) -> DataFrame:
    """Hot or mild and sunny or cloudy. The temperature unit is the caller's; 80 is meant in F."""
    heat = (F.coalesce("temperature", F.lit(70.0)) if "temperature" in merged.columns
            else F.lit(70.0))
    named = [F.col(c) for c in ("cloud_cover", "clouds") if c in merged.columns]
    cover = F.coalesce(*named, F.lit(50.0))
    name = F.concat(F.when(heat > hot, "Hot").otherwise("Mild"), F.lit(" & "),
                    F.when(cover < cloudy, "Sunny").otherwise("Cloudy"))
    return merged.groupBy(SITE, name.alias("condition")).agg(
        F.avg(PRODUCTION).alias("mean_production"), F.count(F.lit(1)).alias("rows"))


def seasonal_weather(merged: DataFrame) -> DataFrame:
    return merged.groupBy(SITE, cal.season(TS).alias("season")).agg(
        F.avg(PRODUCTION).alias("avg_production"), F.avg("temperature").alias("avg_temperature"),
        F.avg("cloud_cover").alias("avg_cloud_cover"), F.count(F.lit(1)).alias("rows"))


def optimal_conditions(merged: DataFrame, cols=(*BASIC, *SOLAR)) -> DataFrame:
    """p25, p75 and mean of each weather column on the best and the worst tenth of rows.

    Hourly rows of a site are bounded by the calendar.
    """
    w = Window.partitionBy(SITE)
    edges = F.percentile(PRODUCTION, F.array(F.lit(0.1), F.lit(0.9))).over(w)
    rows = merged.withColumn("_e", edges)
    parts = {"optimal": F.col(PRODUCTION) >= F.col("_e")[1],
             "suboptimal": F.col(PRODUCTION) <= F.col("_e")[0]}

    def one(name, cond, c):
        v = F.when(cond, F.col(c))
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
        return F.struct(F.lit(c).alias("parameter"), F.lit(name).alias("range"),
                        q[0].alias("p25"), q[1].alias("p75"), F.avg(v).alias("mean"))

    entries = F.array(*[one(n, cond, c) for c in cols for n, cond in parts.items()])
    return rows.groupBy(SITE).agg(entries.alias("e")).select(SITE, F.inline("e"))


def monthly_weather_impact(df: DataFrame) -> DataFrame:
    cols = (PRODUCTION, "sunshine_hours", "cloudcover_mean_pct", "solar_radiation_mj")
    return df.groupBy(SITE, F.month(DAY).alias("month")).agg(
        *[F.avg(c).alias(c) for c in cols]).withColumn("month_name", cal.month_name("month"))


def extreme_weather_days(df: DataFrame, n=5) -> DataFrame:
    """Means over each site's ``n`` best and worst days by weather score."""
    rows = df.where(F.col("solar_weather_score").isNotNull())
    w = Window.partitionBy(SITE)
    best = F.row_number().over(w.orderBy(F.col("solar_weather_score").desc(), DAY))
    worst = F.row_number().over(w.orderBy("solar_weather_score", DAY))
    out = None
    for name, place in (("best", best), ("worst", worst)):
        part = rows.withColumn("_r", place).where(F.col("_r") <= n).groupBy(SITE).agg(
            *[F.avg(c).alias(f"avg_{c}") for c in
              (PRODUCTION, "solar_weather_score", "sunshine_hours", "cloudcover_mean_pct",
               "solar_radiation_mj")]).withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
