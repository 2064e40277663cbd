"""Group-by profiles: hour of day, month of year, quarter, season, year, channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.numeric import ratio
from ..schema import DAY, ENERGY, PRODUCTION, SITE, TS


def hourly_profile(intervals: DataFrame, cols=ENERGY, per_hour=4.0) -> DataFrame:
    """Mean reading by hour of day and its hourly rate (four quarter hours)."""
    out = intervals.groupBy(SITE, F.hour(TS).alias("hour")).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols])
    return out.withColumns({f"{c}_per_hour": F.col(f"avg_{c}") * F.lit(per_hour) for c in cols})


def profile_highlights(profile: DataFrame, threshold=0.01) -> DataFrame:
    """Peak hours, the productive window and the hours above half of the peak."""
    p = F.col(f"avg_{PRODUCTION}")
    peak = F.max(p).over(Window.partitionBy(SITE))
    active = p > threshold

    def peak_hour(c):
        known = F.col(f"avg_{c}").isNotNull()
        return F.max_by("hour", F.when(known, F.struct(F.col(f"avg_{c}"), -F.col("hour"))))

    return profile.withColumn("_peak", peak).groupBy(SITE).agg(
        *[peak_hour(c).alias(f"peak_{c.split('_')[0]}_hour") for c in ENERGY],
        F.max(p).alias("peak_production_kwh"),
        F.min(F.when(active, F.col("hour"))).alias("first_hour"),
        F.max(F.when(active, F.col("hour"))).alias("last_hour"),
        F.count_if(active).alias("productive_hours"),
        F.count_if(p > F.col("_peak") * F.lit(0.5)).alias("peak_period_hours"))


def seasonal_hourly_profile(intervals: DataFrame, value=PRODUCTION) -> DataFrame:
    """Summer and winter curves. A site is southern when its January mean beats its July mean.

    Months and hours are reduced first, so the hemisphere test runs on 288 rows per site.
    """
    cells = intervals.groupBy(SITE, F.month(TS).alias("month"), F.hour(TS).alias("hour")).agg(
        F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(SITE)

    def month_mean(m):
        hit = F.col("month") == m
        return F.try_divide(F.sum(F.when(hit, F.col("s"))).over(w),
                            F.sum(F.when(hit, F.col("n"))).over(w))

    southern = F.coalesce(month_mean(1) > month_mean(7), F.lit(False))
    cold, warm = F.col("month").isin(12, 1, 2), F.col("month").isin(6, 7, 8)
    name = (F.when(cold, F.when(southern, "Summer").otherwise("Winter"))
            .when(warm, F.when(southern, "Winter").otherwise("Summer")))
    return (cells.withColumn("season", name).where(F.col("season").isNotNull())
            .groupBy(SITE, "season", "hour")
            .agg(F.try_divide(F.sum("s"), F.sum("n")).alias(f"avg_{value}")))


def month_of_year_stats(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    """Statistics by month of year (2 decimals) with the site's best and worst month."""
    v = F.col(value)
    stats = daily.groupBy(SITE, F.month(DAY).alias("month")).agg(
        F.round(F.avg(v), 2).alias("mean"), F.round(F.sum(v), 2).alias("sum"),
        F.round(F.stddev_samp(v), 2).alias("std"), F.round(F.min(v), 2).alias("min"),
        F.round(F.max(v), 2).alias("max"), F.count(v).alias("count"))
    w = Window.partitionBy(SITE)
    best = F.max_by("month", F.struct(F.col("mean"), -F.col("month"))).over(w)
    worst = F.min_by("month", F.struct("mean", "month")).over(w)
    return stats.withColumns({
        "month_name": cal.month_name("month"), "best_month": best, "worst_month": worst,
        "seasonal_variation": F.try_divide(F.max("mean").over(w), F.min("mean").over(w))})


def quarter_stats(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    """Mean by quarter; quarter 1 counts as winter."""
    stats = daily.groupBy(SITE, F.quarter(DAY).alias("quarter")).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(SITE)
    return stats.withColumns({
        "season": cal.quarter_season("quarter"),
        "best_quarter": F.max_by("quarter", F.struct(F.col("mean"), -F.col("quarter"))).over(w),
        "worst_quarter": F.min_by("quarter", F.struct("mean", "quarter")).over(w),
        "variation": F.try_divide(F.max("mean").over(w), F.min("mean").over(w))})


def season_stats(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    return daily.groupBy(SITE, cal.season(DAY).alias("season")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("variance"))


def calendar_month_totals(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    return daily.groupBy(SITE, F.trunc(DAY, "MM").alias("month_start")).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("sum"))


def monthly_efficiency(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    """Energy per approximate daylight hour by month of year."""
    per_hour = F.col(value) / cal.approximate_daylight(DAY)
    return daily.groupBy(SITE, F.month(DAY).alias("month")).agg(
        F.avg(per_hour).alias("kwh_per_daylight_hour"))


def monthly_savings(daily: DataFrame, rate=0.12, value=PRODUCTION) -> DataFrame:
    """Twelve rows per site, 0 for a month without data."""
    sums = F.array(*[F.struct(
        F.lit(m).alias("month"), F.lit(name).alias("month_name"),
        (F.coalesce(F.sum(F.when(F.month(DAY) == m, F.col(value))), F.lit(0.0)) * F.lit(rate))
        .alias("savings")) for m, name in enumerate(cal.MONTH_NAMES, 1)])
    return daily.groupBy(SITE).agg(sums.alias("m")).select(SITE, F.inline("m"))


def monthly_peaks(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    """Best day of each calendar month with the site's linear trend over days."""
    peaks = daily.groupBy(SITE, F.trunc(DAY, "MM").alias("month_start")).agg(
        F.max(value).alias("peak_kwh"))
    w = Window.partitionBy(SITE)
    x = F.datediff("month_start", F.min("month_start").over(w))
    return peaks.withColumn("day_offset", x.cast("double")).withColumns({
        "slope": F.regr_slope("peak_kwh", "day_offset").over(w),
        "intercept": F.regr_intercept("peak_kwh", "day_offset").over(w)})


def peak_trend(peaks: DataFrame, span=6) -> DataFrame:
    """Mean of the first and the last ``span`` monthly peaks; only with more than ``span``."""
    w = Window.partitionBy(SITE)
    ranked = peaks.withColumns({
        "_first": F.row_number().over(w.orderBy("month_start")),
        "_last": F.row_number().over(w.orderBy(F.col("month_start").desc()))})
    out = ranked.groupBy(SITE).agg(
        F.avg(F.when(F.col("_first") <= span, F.col("peak_kwh"))).alias("early_mean"),
        F.avg(F.when(F.col("_last") <= span, F.col("peak_kwh"))).alias("recent_mean"),
        F.count(F.lit(1)).alias("months"), F.first("slope").alias("slope"))
    verdict = F.when(F.col("recent_mean") > F.col("early_mean"), "improving").otherwise("declining")
    return out.where(F.col("months") > span).withColumn("trend", verdict)


def yearly_totals(daily: DataFrame, value=PRODUCTION, min_days=365) -> DataFrame:
    """Totals by year for sites with more than ``min_days`` days, with the yearly change."""
    years = daily.groupBy(SITE, F.year(DAY).alias("year")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("days"))
    w = Window.partitionBy(SITE)
    previous = F.lag("total").over(w.orderBy("year"))
    return (years.withColumns({"_days": F.sum("days").over(w), "change": F.col("total") - previous,
                               "change_pct": ratio(F.col("total") - previous, previous)
                               * F.lit(100.0)})
            .where(F.col("_days") > min_days).drop("_days"))


def channel_totals(meter: DataFrame) -> DataFrame:
    return meter.groupBy(SITE, "channel").agg(
        F.sum("energy_delivered_kwh").alias("total_kwh"), F.count(F.lit(1)).alias("intervals"))
