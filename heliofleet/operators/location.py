"""Solar geometry of sites over time. ``sites`` is joined on its key; the planner broadcasts
it while it is below its size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import calendar as cal, solar
from ..functions.numeric import ratio
from ..schema import CONSUMPTION, DAY, PRODUCTION, SITE, TS
from ..sources import dims
from .quantiles import attach_per_site

SUMMER_DAY, WINTER_DAY = "2024-06-21", "2024-12-21"


def checked_sites(sites: DataFrame) -> DataFrame:
    """Raise when a latitude or longitude is out of range."""
    def within(c, limit):
        return (F.when(F.abs(c) <= limit, F.col(c))
                .otherwise(F.raise_error(F.concat(F.lit(f"{c} out of range: "),
                                                  F.col(c).cast("string"))).cast("double")))
    return sites.withColumns({"latitude": within("latitude", 90),
                              "longitude": within("longitude", 180)})


def site_climate(sites: DataFrame) -> DataFrame:
    return sites.withColumns(solar.climate_columns("latitude"))


def with_geometry(df: DataFrame, day_of_year: Column) -> DataFrame:
    """Declination, sunrise, sunset and daylight for rows that carry ``latitude``."""
    df = df.withColumn("_doy", day_of_year)
    return df.withColumns({
        "declination": solar.declination("_doy"),
        "sunrise_hour": solar.sunrise_hour("latitude", "_doy"),
        "sunset_hour": solar.sunset_hour("latitude", "_doy"),
        "daylight_hours": solar.daylight_hours("latitude", "_doy")}).drop("_doy")


def enrich_readings(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Elevation, clear-sky irradiance, seasonal and cloud factor, sunrise and daylight."""
    place = site_climate(sites).select(SITE, "latitude", "longitude", "cloud_factor",
                                       "seasonal_variation", "atmospheric_transmission")
    doy, clock = F.dayofyear(TS), F.hour(TS) + F.minute(TS) / F.lit(60.0)
    df = attach_per_site(df, place).withColumn("_doy", doy)
    df = df.withColumn("solar_elevation", solar.elevation("latitude", "_doy", clock))
    return df.withColumns({
        "theoretical_irradiance": solar.irradiance("solar_elevation", "atmospheric_transmission"),
        "seasonal_factor": solar.seasonal_factor("latitude", "_doy", "seasonal_variation"),
        "weather_factor": solar.base_cloud_factor("_doy", "cloud_factor"),
        "sunrise_hour": solar.sunrise_hour("latitude", "_doy"),
        "sunset_hour": solar.sunset_hour("latitude", "_doy"),
        "daylight_hours": solar.daylight_hours("latitude", "_doy"),
    }).drop("_doy", "cloud_factor", "seasonal_variation", "atmospheric_transmission")


def enrich_daily(df: DataFrame, sites: DataFrame, clock_hour=12.0) -> DataFrame:
    """Daylight, elevation and irradiance of a day at ``clock_hour`` (noon, not midnight)."""
    place = site_climate(sites).select(SITE, "latitude", "longitude", "climate_type_encoded",
                                       "seasonal_variation", "atmospheric_transmission")
    df = df.join(place, SITE, "left").withColumn("_doy", F.dayofyear(DAY))
    df = df.withColumns({
        "theoretical_daylight_hours": solar.daylight_hours("latitude", "_doy"),
        "max_solar_elevation": solar.elevation("latitude", "_doy", F.lit(float(clock_hour)))})
    return df.withColumn("theoretical_irradiance", solar.irradiance(
        "max_solar_elevation", "atmospheric_transmission")).drop("_doy")


def location_efficiency(df: DataFrame) -> DataFrame:
    """Production per daylight hour, irradiance and elevation, and the mean of the first two."""
    p = F.col(PRODUCTION)
    df = df.withColumns({
        "daylight_utilization": ratio(p, F.col("theoretical_daylight_hours") + F.lit(0.1)),
        "irradiance_efficiency": ratio(p, F.col("theoretical_irradiance") + F.lit(0.1)),
        "elevation_efficiency": ratio(p, F.col("max_solar_elevation") + F.lit(0.1))})
    return df.withColumn("solar_efficiency_score", F.col("daylight_utilization") * F.lit(0.5)
                         + F.col("irradiance_efficiency") * F.lit(0.5))


def theoretical_features(df: DataFrame) -> DataFrame:
    """Seasonal factor, daylight within the site's yearly range and a capacity factor.

    Input: the columns of ``enrich_daily``.
    """
    summer, winter = (solar.daylight_hours("latitude", F.dayofyear(F.lit(d).cast("date")))
                      for d in (SUMMER_DAY, WINTER_DAY))
    w = Window.partitionBy(SITE)
    df = df.withColumns({"_sun": F.avg("theoretical_irradiance").over(w),
                         "_mean": F.avg(PRODUCTION).over(w)})
    sun = F.col("_sun")
    wave = F.cos(F.lit(2 * 3.141592653589793) * (F.dayofyear(DAY) - F.lit(172)) / F.lit(365.25))
    return df.withColumns({
        "theoretical_seasonal_factor": F.lit(1.0) + F.col("seasonal_variation") * wave,
        "daylight_hours_normalized": ratio(F.col("theoretical_daylight_hours") - winter,
                                           summer - winter + F.lit(0.1)),
        "location_capacity_factor": F.when(sun > 0, F.col("_mean") / sun)
        .otherwise(F.lit(0.15))}).drop("seasonal_variation", "atmospheric_transmission", "_sun", "_mean")


def geometry_calendar(sites: DataFrame, year: int) -> DataFrame:
    """One row per site and day of a year."""
    days = F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)),
                                F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    df = site_climate(sites).select(SITE, "latitude", "seasonal_variation", days.alias(DAY))
    doy = F.dayofyear(DAY)
    return with_geometry(df, doy).withColumns({
        "noon_elevation": solar.elevation("latitude", doy, F.lit(12.0)),
        "seasonal_factor": solar.seasonal_factor("latitude", doy, "seasonal_variation"),
        "day_of_year": doy}).drop("seasonal_variation")


def geometry_extremes(calendar: DataFrame) -> DataFrame:
    """Longest and shortest day and the range of noon elevation."""
    day, light = F.col(DAY), F.round("daylight_hours", 9)
    return calendar.groupBy(SITE).agg(
        F.min_by(DAY, F.struct(-light, day)).alias("longest_day"),
        F.max("daylight_hours").alias("longest_hours"),
        F.min_by(DAY, F.struct(light, day)).alias("shortest_day"),
        F.min("daylight_hours").alias("shortest_hours"),
        F.max("noon_elevation").alias("max_elevation"),
        F.min("noon_elevation").alias("min_elevation"))


def solar_profile(sites: DataFrame, day) -> DataFrame:
    """Profile of each site on one day."""
    day = F.lit(day).cast("date") if isinstance(day, str) else day
    doy = F.dayofyear(DAY)
    df = site_climate(sites).withColumn(DAY, day)
    df = with_geometry(df, doy).withColumns({
        "seasonal_factor": solar.seasonal_factor("latitude", doy, "seasonal_variation"),
        "weather_factor": solar.base_cloud_factor(doy, "cloud_factor"),
        "peak_irradiance": solar.irradiance(
            solar.elevation("latitude", doy, F.lit(12.0)), F.col("atmospheric_transmission"))})
    return df.withColumn("daily_solar_factor", F.col("seasonal_factor") * F.col("weather_factor"))


def location_summary(sites: DataFrame) -> DataFrame:
    """Climate and the daylight of the two solstices."""
    def light(day):
        return solar.daylight_hours("latitude", F.dayofyear(F.lit(day).cast("date")))

    keep = [c for c in (SITE, "city") if c in sites.columns]
    return site_climate(sites).select(
        *keep, "location_name", "latitude", "longitude", "timezone", "climate_type",
        "climate_type_encoded", light(SUMMER_DAY).alias("summer_daylight_hours"),
        light(WINTER_DAY).alias("winter_daylight_hours"), "seasonal_variation",
        F.col("cloud_factor").alias("typical_cloud_factor"),
        F.col("atmospheric_transmission").alias("atmospheric_clarity"))


def compare_cities(spark: SparkSession, names=("phoenix", "miami", "seattle", "denver")):
    """Location summary of named cities."""
    return location_summary(dims.cities(spark).where(F.col("city").isin(*names)))


def location_daily(enriched: DataFrame) -> DataFrame:
    """Day totals of enriched readings; daylight is that of the first reading."""
    out = enriched.groupBy(SITE, F.to_date(TS).alias(DAY)).agg(
        F.sum(PRODUCTION).alias(PRODUCTION), F.sum(CONSUMPTION).alias(CONSUMPTION),
        F.max("solar_elevation").alias("solar_elevation"),
        F.max("theoretical_irradiance").alias("theoretical_irradiance"),
        F.avg("seasonal_factor").alias("seasonal_factor"),
        F.avg("weather_factor").alias("weather_factor"),
        F.min_by("daylight_hours", TS).alias("daylight_hours"))
    out = out.fillna(0.0, [PRODUCTION, CONSUMPTION])
    return out.withColumns({
        "production_per_daylight_hour": ratio(PRODUCTION, "daylight_hours"),
        "month": F.month(DAY), "day_of_year": F.dayofyear(DAY)})


def location_monthly(daily: DataFrame) -> DataFrame:
    p = F.col(PRODUCTION)
    return daily.groupBy(SITE, F.month(DAY).alias("month")).agg(
        F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"),
        F.max(p).alias("max"), F.avg("daylight_hours").alias("daylight_hours"),
        F.avg("theoretical_irradiance").alias("theoretical_irradiance"),
        F.avg("seasonal_factor").alias("seasonal_factor"),
        F.avg("weather_factor").alias("weather_factor"))


def daylight_profile(df: DataFrame) -> DataFrame:
    return df.withColumn("approx_daylight_hours", cal.approximate_daylight(DAY))
