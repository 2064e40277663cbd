"""Filters, top-k and cleaning.

Top-k per site is ``row_number() <= k``: Spark keeps k rows per site in each map task
before the shuffle, so a dominant site does not travel whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import DAY, SITE, TS


def hour_filter(df: DataFrame, hours) -> DataFrame:
    return df.where(F.hour(TS).isin(*hours))


def top_per_site(df: DataFrame, order, n: int, rank="rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(SITE).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def head(df: DataFrame, n=5) -> DataFrame:
    """First rows of each site in time order."""
    stamp = TS if TS in df.columns else DAY
    return top_per_site(df, [F.col(stamp)], n)


def tail(df: DataFrame, n=10) -> DataFrame:
    """Last rows of each site, newest first."""
    stamp = TS if TS in df.columns else DAY
    return top_per_site(df, [F.col(stamp).desc()], n)


def producing_only(meter: DataFrame, power="current_power_w") -> DataFrame:
    return meter.where(F.col(power) > 0)


def power_summary(meter: DataFrame, power="current_power_w") -> DataFrame:
    """Peak and mean power while producing."""
    return producing_only(meter, power).groupBy(SITE).agg(
        F.max(power).alias("peak_power_w"), F.avg(power).alias("avg_power_w"),
        F.count(F.lit(1)).alias("producing_intervals"))


def first_of_day(meter: DataFrame, power="current_power_w") -> DataFrame:
    """First producing interval of each day, by a partial aggregate instead of a sort."""
    row = F.struct(TS, "channel", power)
    return (producing_only(meter, power).groupBy(SITE, F.to_date(TS).alias(DAY))
            .agg(F.min(row).alias("r")).select(SITE, DAY, "r.*"))


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def fill_missing(df: DataFrame) -> DataFrame:
    """Carry ``lag_`` columns forward, fill ``rolling_`` columns with the site mean, the rest 0."""
    past = Window.partitionBy(SITE).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    site = Window.partitionBy(SITE)
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long")
               and f.name != SITE]
    out = {}
    for c in numeric:
        if "lag_" in c:
            value = F.last(c, ignorenulls=True).over(past)
        elif "rolling_" in c:
            value = F.coalesce(F.col(c), F.avg(c).over(site))
        else:
            value = F.col(c)
        out[c] = F.coalesce(value, F.lit(0))
    return df.withColumns(out)


def new_columns(before: DataFrame, after: DataFrame, keys=(SITE, DAY)) -> DataFrame:
    """Keys and the columns that ``after`` adds."""
    added = [c for c in after.columns if c not in before.columns]
    return after.select(*keys, *added)


def largest_gaps(gaps: DataFrame) -> DataFrame:
    """Gaps by size, largest first (a total sort by range partitions)."""
    return gaps.orderBy(F.col("gap_seconds").desc(), SITE, "gap_start")
