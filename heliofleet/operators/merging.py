"""Joins of feeds: weather to production, two sources by priority, incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import DAY, ENERGY, PRODUCTION, SITE, TS

PRIORITIES = ("csv_only", "csv_first", "api_first")


def _hourly_mean(df: DataFrame) -> DataFrame:
    stamp = F.col(TS) if TS in df.columns else F.col(DAY).cast("timestamp")
    cols = [c for c in df.columns if c not in (SITE, TS, DAY)]
    return df.groupBy(SITE, F.date_trunc("hour", stamp).alias(TS)).agg(
        *[F.avg(c).alias(c) for c in cols])


def merge_weather_hourly(production: DataFrame, weather: DataFrame) -> DataFrame:
    """Both sides to hourly means (map-side first), then an inner join on site and hour."""
    return _hourly_mean(production).join(_hourly_mean(weather), [SITE, TS])


def merge_counts(merged: DataFrame, value=PRODUCTION) -> DataFrame:
    """Joined rows and those with a value; the reference count is of joined rows."""
    return merged.groupBy(SITE).agg(F.count(F.lit(1)).alias("data_points"),
                                    F.count(value).alias("usable_rows"),
                                    F.min(TS).alias("start"), F.max(TS).alias("end"))


def merge_weather_daily(production: DataFrame, weather: DataFrame, how="left") -> DataFrame:
    return production.join(weather, [SITE, DAY], how)


def merge_sources(csv: DataFrame, api: DataFrame, priority="csv_first") -> DataFrame:
    """Rows of the preferred daily source, plus production alone for days only the other has."""
    if priority not in PRIORITIES:
        raise ValueError(f"priority must be one of {PRIORITIES}")
    if priority == "csv_only":
        return csv.withColumn("source", F.lit("csv"))
    names = ("csv", "api") if priority == "csv_first" else ("api", "csv")
    first, second = (csv, api) if priority == "csv_first" else (api, csv)
    extra = second.select(SITE, DAY, PRODUCTION).join(first, [SITE, DAY], "left_anti")
    out = first.withColumn("source", F.lit(names[0])).unionByName(
        extra.withColumn("source", F.lit(names[1])), allowMissingColumns=True)
    for c in ENERGY:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(SITE, DAY, *ENERGY, "source")


def recent_totals(csv: DataFrame, api: DataFrame, as_of, days=30) -> DataFrame:
    """Rows, total and mean of the last ``days`` days under each priority."""
    def one(priority):
        window = date_range_filter(merge_sources(csv, api, priority),
                                   F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of))
        return window.groupBy(SITE).agg(
            F.count(F.lit(1)).alias("records"), F.sum(PRODUCTION).alias("total_kwh"),
            F.avg(PRODUCTION).alias("average_daily_kwh"), F.min(DAY).alias("start_day"),
            F.max(DAY).alias("end_day")).withColumn("priority", F.lit(priority))

    frames = [one(p) for p in PRIORITIES]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def source_overlap(csv: DataFrame, api: DataFrame) -> DataFrame:
    """Days in both sources and in one only."""
    a = csv.select(SITE, DAY).distinct().withColumn("a", F.lit(1))
    b = api.select(SITE, DAY).distinct().withColumn("b", F.lit(1))
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return a.join(b, [SITE, DAY], "full_outer").groupBy(SITE).agg(
        F.count_if(has_a & has_b).alias("both"), F.count_if(has_a & ~has_b).alias("csv_only"),
        F.count_if(~has_a & has_b).alias("api_only"))


def incremental_update(current: DataFrame, fresh: DataFrame, prefer="current"):
    """``(updated, statistics)``: new days are appended with production only.

    Days present on both sides are counted but keep their current values, unless
    ``prefer="fresh"`` takes the production of the fresh feed.
    """
    days = current.select(SITE, DAY)
    fresh = fresh.select(SITE, DAY, PRODUCTION)
    new = fresh.join(days, [SITE, DAY], "left_anti")
    kept = current
    if prefer == "fresh":
        newer = fresh.withColumnRenamed(PRODUCTION, "_fresh")
        kept = current.join(newer, [SITE, DAY], "left").withColumn(
            PRODUCTION, F.coalesce("_fresh", PRODUCTION)).drop("_fresh")
    updated = kept.unionByName(new, allowMissingColumns=True)
    seen = (fresh.select(SITE, DAY, F.lit(1).alias("f"))
            .join(days.withColumn("c", F.lit(1)), [SITE, DAY], "full_outer"))
    has_f, has_c = F.col("f").isNotNull(), F.col("c").isNotNull()
    stats = seen.groupBy(SITE).agg(
        F.count_if(has_c).alias("existing_records"), F.count_if(has_f).alias("api_records"),
        F.count_if(has_f & ~has_c).alias("new_records"),
        F.count_if(has_f & has_c).alias("updated_records"))
    return updated, stats


def date_range_filter(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive on both ends; reaches the Parquet scan when ``df`` is one."""
    stamp = F.col(DAY) if DAY in df.columns else F.to_date(TS)
    if start is not None:
        df = df.where(stamp >= (F.lit(start).cast("date") if isinstance(start, str) else start))
    if end is not None:
        df = df.where(stamp <= (F.lit(end).cast("date") if isinstance(end, str) else end))
    return df


def intervals_for_day(intervals: DataFrame, meter: DataFrame, day: str) -> DataFrame:
    """Readings of one day; sites without any fall back to the meter feed, all channels added."""
    target = F.lit(day).cast("date")
    start = F.lit(day).cast("timestamp")
    inside = (F.col(TS) >= start) & (F.col(TS) < start + F.expr("INTERVAL 1 DAY"))
    own = intervals.where(inside).select(SITE, TS, *[c for c in ENERGY if c in intervals.columns])
    fallback = (meter.where(inside).groupBy(SITE, TS)
                .agg(F.sum("energy_delivered_kwh").alias(PRODUCTION))
                .join(own.select(SITE).distinct(), SITE, "left_anti"))
    return (own.withColumn("source", F.lit("csv"))
            .unionByName(fallback.withColumn("source", F.lit("api")), allowMissingColumns=True)
            .withColumn(DAY, target))


def recent_daily(daily: DataFrame, as_of: str, n=7) -> DataFrame:
    """One row per site for each of the ``n`` days before ``as_of``; absent days are 0."""
    last = F.date_sub(F.lit(as_of).cast("date"), 1)
    first = F.date_sub(F.lit(as_of).cast("date"), n)
    sums = F.array(*[F.struct(
        F.date_sub(F.lit(as_of).cast("date"), k).alias(DAY),
        F.coalesce(F.sum(F.when(F.col(DAY) == F.date_sub(F.lit(as_of).cast("date"), k),
                                F.col(PRODUCTION))), F.lit(0.0)).alias(PRODUCTION))
        for k in range(1, n + 1)])
    known = daily.select(SITE).distinct()
    window = daily.where(F.col(DAY).between(first, last)).select(SITE, DAY, PRODUCTION)
    return (known.withColumns({DAY: F.lit(None).cast("date"), PRODUCTION: F.lit(None).cast("double")})
            .unionByName(window).groupBy(SITE).agg(sums.alias("d")).select(SITE, F.inline("d"))
            .withColumn("has_data", F.col(PRODUCTION) > 0))


def day_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days of ``a`` that ``b`` lacks."""
    return a.select(SITE, DAY).distinct().join(b.select(SITE, DAY), [SITE, DAY], "left_anti")


def day_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(SITE, DAY).distinct().join(b.select(SITE, DAY), [SITE, DAY], "left_semi")


def distinct_values(df: DataFrame, *cols) -> DataFrame:
    return df.select(SITE, *cols).distinct()


def broadcast_back(df: DataFrame, value, keys=(SITE,), name=None) -> DataFrame:
    """Mean of a group repeated on its rows."""
    return df.withColumn(name or f"mean_{value}", F.avg(value).over(Window.partitionBy(*keys)))
