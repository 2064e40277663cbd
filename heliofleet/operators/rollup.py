"""Gap-filled rollups to days and months.

Plan of a daily rollup: partial sums before the shuffle on ``(site_id, day)``, so a site
that holds a third of all readings is reduced where it is read; then one shuffle on
``site_id``, which the gap fill and every later window share. From there on a site has at
most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..schema import DAY, ENERGY, SITE, TS
from .metrics import net_energy, self_consumption

METHODS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def _aggregates(cols, method):
    if method not in METHODS:
        raise ValueError(f"unsupported aggregation method: {method}")
    return [METHODS[method](c).alias(c) for c in cols]


def _energy_cols(df, cols):
    return [c for c in (cols or ENERGY) if c in df.columns]


def fill_days(daily: DataFrame, cols=None, fill=0.0) -> DataFrame:
    """Insert the missing days between the first and the last day of each site.

    Each day is stretched up to the day before its successor, so no spine is built or
    joined: one window over the site and one ``explode``.
    """
    cols = _energy_cols(daily, cols)
    others = [c for c in daily.columns if c not in (SITE, DAY, *cols)]
    successor = F.lead(DAY).over(Window.partitionBy(SITE).orderBy(DAY))
    last = F.coalesce(F.date_sub(successor, 1), F.col(DAY))
    stretched = daily.withColumn("_until", last).select(
        SITE, F.col(DAY).alias("_from"), *cols, *others,
        F.explode(F.sequence(F.col(DAY), F.col("_until"))).alias(DAY))
    real = F.col(DAY) == F.col("_from")
    return stretched.select(
        SITE, DAY,
        *[F.when(real, F.col(c)).otherwise(F.lit(fill)).alias(c) for c in cols],
        *[F.when(real, F.col(c)).alias(c) for c in others])


def fill_months(monthly: DataFrame, cols, fill=0.0) -> DataFrame:
    """As ``fill_days`` for month-end labels in ``month_end``."""
    successor = F.lead("month_end").over(Window.partitionBy(SITE).orderBy("month_end"))
    first = F.trunc("month_end", "MM")
    last = F.coalesce(F.add_months(F.trunc(successor, "MM"), -1), first)
    stretched = monthly.withColumn("_until", last).select(
        SITE, F.col("month_end").alias("_from"), *cols,
        F.explode(F.sequence(first, F.col("_until"), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    real = F.last_day("_month") == F.col("_from")
    return stretched.select(SITE, F.last_day("_month").alias("month_end"),
                            *[F.when(real, F.col(c)).otherwise(F.lit(fill)).alias(c)
                              for c in cols])


def daily_summary(df: DataFrame, method: str = "sum", cols=None, fill_gaps=True) -> DataFrame:
    """Readings (``ts``) or days (``day``) to one row per site and day.

    An empty day sums to 0; its mean, maximum and minimum are NULL.
    """
    cols = _energy_cols(df, cols)
    day = F.to_date(TS).alias(DAY) if TS in df.columns else F.col(DAY)
    out = df.groupBy(SITE, day).agg(*_aggregates(cols, method))
    if method == "sum":
        out = out.fillna(0.0, cols)
    if not fill_gaps:
        return out
    return fill_days(out, cols, 0.0 if method == "sum" else None)


def monthly_summary(df: DataFrame, method: str = "sum", cols=None, fill_gaps=True) -> DataFrame:
    """One row per site and month, labelled by the last day of the month."""
    cols = _energy_cols(df, cols)
    stamp = TS if TS in df.columns else DAY
    out = df.groupBy(SITE, F.last_day(stamp).alias("month_end")).agg(*_aggregates(cols, method))
    if method == "sum":
        out = out.fillna(0.0, cols)
    if not fill_gaps:
        return out
    return fill_months(out, cols, 0.0 if method == "sum" else None)


def enhanced_daily_summary(df: DataFrame, method: str = "sum") -> DataFrame:
    """Daily rollup with net energy, self-consumption and calendar columns."""
    daily = self_consumption(net_energy(daily_summary(df, method)))
    return daily.withColumns(cal.time_feature_columns(DAY))


def standard_datasets(intervals: DataFrame, with_features=False) -> dict[str, DataFrame]:
    """Interval, daily, monthly, metric and feature frames that share one daily rollup.

    The caller may ``persist`` the daily frame when several of them are written.
    """
    daily = daily_summary(intervals)
    out = {"interval": intervals, "daily": daily, "monthly": monthly_summary(daily),
           "daily_with_metrics": net_energy(self_consumption(daily))}
    if with_features:
        from ..plans.features import ml_dataset_basic

        out["features"] = ml_dataset_basic(daily)
    return out
