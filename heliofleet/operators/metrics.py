"""Row-wise energy metrics and per-site statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import ascending_band, clip, positive_ratio, ratio, ratio_or
from ..schema import CONSUMPTION, DAY, EXPORT, IMPORT, PRODUCTION, SITE

def net_energy(df: DataFrame) -> DataFrame:
    """Net energy, surplus flag and self-sufficiency capped at 100 %.

    Production without consumption is fully self-sufficient; 0 / 0 is unknown.
    """
    p, c = F.col(PRODUCTION), F.col(CONSUMPTION)
    share = F.when(c == 0, F.when(p > 0, F.lit(100.0))).otherwise(ratio(p, c) * F.lit(100.0))
    return df.withColumns({
        "net_energy_kwh": p - c, "energy_surplus": (p - c) > 0,
        "self_sufficiency_pct": F.when(share.isNotNull(), F.least(F.lit(100.0), share))})


def self_consumption(df: DataFrame) -> DataFrame:
    """Self-consumed energy, its share of production and of consumption in 0..100."""
    used = F.col(PRODUCTION) - F.col(EXPORT)
    return df.withColumns({
        "self_consumed_kwh": used,
        "self_consumption_rate_pct": clip(
            ratio_or(used, F.col(PRODUCTION), 0.0) * F.lit(100.0), 0, 100),
        "grid_independence_pct": clip(
            ratio_or(used, F.col(CONSUMPTION), 0.0) * F.lit(100.0), 0, 100)})


def production_statistics(daily: DataFrame) -> DataFrame:
    """One row per site. Days are compared with the site mean by a window that shares the
    partitioning of the aggregate, so the daily table is shuffled once."""
    p = F.col(PRODUCTION)
    mean = F.avg(p).over(Window.partitionBy(SITE))
    stats = daily.select(SITE, PRODUCTION, mean.alias("_mean")).groupBy(SITE).agg(
        F.sum(p).alias("total_production"), F.avg(p).alias("average_daily"),
        F.percentile(p, F.lit(0.5)).alias("median_daily"),
        F.stddev_samp(p).alias("std_deviation"), F.min(p).alias("min_daily"),
        F.max(p).alias("max_daily"), F.percentile(p, F.lit(0.25)).alias("quartile_25"),
        F.percentile(p, F.lit(0.75)).alias("quartile_75"),
        F.count_if(p > F.col("_mean") * F.lit(0.1)).alias("productive_days"),
        F.count_if(p == 0).alias("zero_production_days"),
        F.count(F.lit(1)).alias("analysis_period"))
    return stats.withColumns({
        "coefficient_of_variation": positive_ratio("std_deviation", "average_daily"),
        "productive_days_pct": ratio("productive_days", "analysis_period") * F.lit(100.0)})


def consumption_statistics(daily: DataFrame) -> DataFrame:
    """Consumption statistics and the site's exchange with the grid."""
    c = F.col(CONSUMPTION)
    out = daily.groupBy(SITE).agg(
        F.sum(c).alias("total_consumption"), F.avg(c).alias("average_daily"),
        F.min(c).alias("min_daily"), F.max(c).alias("max_daily"),
        F.stddev_samp(c).alias("std_deviation"), F.sum(EXPORT).alias("total_export"),
        F.sum(IMPORT).alias("total_import"), F.sum(PRODUCTION).alias("total_production"))
    kept = F.col("total_production") - F.col("total_export")
    return out.withColumns({
        "net_export": F.col("total_export") - F.col("total_import"), "self_consumption_kwh": kept,
        "self_consumption_rate": positive_ratio(kept, "total_production") * F.lit(100.0),
        "grid_independence_rate": F.when(
            F.col("total_consumption") > 0,
            (F.lit(1.0) - ratio("total_import", "total_consumption")) * F.lit(100.0))
        .otherwise(F.lit(0.0))}).drop("total_production")


def surplus_days(daily: DataFrame) -> DataFrame:
    net = F.col(PRODUCTION) - F.col(CONSUMPTION)
    out = daily.groupBy(SITE).agg(
        F.count_if(net > 0).alias("surplus_days"), F.count(F.lit(1)).alias("days"),
        F.sum(net).alias("net_balance_kwh"), F.sum(EXPORT).alias("total_export"),
        F.sum(PRODUCTION).alias("total_production"))
    return out.withColumns({
        "surplus_pct": ratio("surplus_days", "days") * F.lit(100.0),
        "self_consumption_rate": positive_ratio(
            F.col("total_production") - F.col("total_export"), "total_production")
        * F.lit(100.0)}).drop("total_production")


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, std, min, quartiles and max per site and column, in one pass."""
    def summary(c):
        v = F.col(c)
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("p25"),
            q[1].alias("p50"), q[2].alias("p75"), F.max(v).alias("max"))

    return (df.groupBy(SITE).agg(F.array(*[summary(c) for c in cols]).alias("s"))
            .select(SITE, F.inline("s")))


def freshness(df: DataFrame, as_of) -> DataFrame:
    """Latest day, its age at ``as_of`` and the age band."""
    stamp = DAY if DAY in df.columns else "ts"
    out = df.groupBy(SITE).agg(F.max(F.to_date(stamp)).alias("latest_day"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest_day"))
    return out.withColumn("days_old", age).withColumn(
        "recency", ascending_band("days_old", (7, 30, 90),
                                  ("very recent", "recent", "somewhat old", "old")))
