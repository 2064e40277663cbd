"""Steps, gaps and granularity of reading times.

Equal times of a site are merged to counts before the shuffle and neighbours are found
inside ``(site_id, day)`` groups; the step over midnight comes from the per-day first and
last times. No task sees a whole site history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import DAY, SITE, TS
from .quantiles import attach_per_site

# Step in seconds and name.
STEP_NAMES = {900: "15min", 3600: "hourly", 86400: "daily"}
EXPECTED_PER_DAY = {"15min": 96, "hourly": 24, "daily": 1}


def _stamp(df):
    return TS if TS in df.columns else DAY


def distinct_times(df: DataFrame) -> DataFrame:
    ts = F.col(_stamp(df)).cast("timestamp")
    return df.groupBy(SITE, F.to_date(ts).alias("_d"), ts.alias(TS)).agg(
        F.count(F.lit(1)).alias("copies"))


def steps(df: DataFrame) -> DataFrame:
    """``site_id, prev_ts, ts, step_seconds, n``: every pair of neighbouring rows, where
    ``n`` rows share the pair. Copies of a time count as steps of 0 seconds."""
    times = distinct_times(df)
    within = times.withColumn(
        "prev_ts", F.lag(TS).over(Window.partitionBy(SITE, "_d").orderBy(TS)))
    days = times.groupBy(SITE, "_d").agg(F.min(TS).alias(TS), F.max(TS).alias("_last"))
    across = days.withColumn("prev_ts", F.lag("_last").over(Window.partitionBy(SITE).orderBy("_d")))
    copies = times.where(F.col("copies") > 1).select(
        SITE, F.col(TS).alias("prev_ts"), TS, (F.col("copies") - 1).alias("n"))
    pairs = (within.select(SITE, "prev_ts", TS).unionByName(across.select(SITE, "prev_ts", TS))
             .where(F.col("prev_ts").isNotNull()).withColumn("n", F.lit(1).cast("bigint")))
    return pairs.unionByName(copies).withColumn(
        "step_seconds", F.unix_seconds(TS) - F.unix_seconds("prev_ts"))


def granularity(df: DataFrame) -> DataFrame:
    """Most common step per site; the smallest of equally common ones."""
    return name_steps(common_step(steps(df)))


def common_step(step_rows: DataFrame) -> DataFrame:
    counted = step_rows.groupBy(SITE, "step_seconds").agg(F.sum("n").alias("n"))
    return counted.groupBy(SITE).agg(
        F.max_by("step_seconds", F.struct(F.col("n"), -F.col("step_seconds")))
        .alias("step_seconds"), F.sum("n").alias("steps"))


def name_steps(df: DataFrame) -> DataFrame:
    step = F.col("step_seconds")
    name = F.concat(F.lit("custom_"), step.cast("string"), F.lit("s"))
    for seconds, label in STEP_NAMES.items():
        name = F.when(step == seconds, F.lit(label)).otherwise(name)
    return df.withColumn("granularity", name)


def time_gaps(df: DataFrame, tolerance=1.5) -> DataFrame:
    """Steps longer than ``tolerance`` times the site's common step."""
    rows = steps(df)
    expected = common_step(rows).select(SITE, F.col("step_seconds").alias("expected_seconds"))
    return (attach_per_site(rows, expected)
            .where(F.col("step_seconds") > F.col("expected_seconds") * F.lit(tolerance))
            .select(SITE, F.col("prev_ts").alias("gap_start"), F.col(TS).alias("gap_end"),
                    F.col("step_seconds").alias("gap_seconds"), "expected_seconds"))


def step_counts(df: DataFrame) -> DataFrame:
    """``site_id, step_seconds, n, first_ts, last_ts``: steps between neighbouring rows, in one pass.

    A day of a site is reduced to its first and last time and the counts of its steps; the steps
    over midnight join the days. The first row of a site has a step of NULL, so the counts
    add up to its rows.
    """
    times = distinct_times(df).groupBy(SITE, "_d").agg(
        F.array_sort(F.collect_list(F.struct(F.unix_seconds(TS).alias("t"), "copies"))).alias("p"))
    ends = times.select(
        SITE, "_d", F.col("p")[0]["t"].alias("lo"), F.element_at("p", -1)["t"].alias("hi"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["copies"] - 1).alias("again"),
        F.zip_with(F.slice("p", F.lit(2), F.size("p")), F.slice("p", F.lit(1), F.size("p") - 1),
                   lambda x, y: x["t"] - y["t"]).alias("s"))
    within = F.transform(F.array_distinct("s"), lambda k: F.struct(
        k.alias("step"), F.size(F.filter("s", lambda x: x == k)).cast("bigint").alias("n")))
    pieces = ends.select(SITE, "_d", "lo", "hi", "again", within.alias("w"))
    over = F.col("lo") - F.lag("hi").over(Window.partitionBy(SITE).orderBy("_d"))
    one = F.lit(1).cast("bigint")
    all_steps = F.concat("w", F.array(F.struct(over.alias("step"), one.alias("n")),
                                      F.struct(F.lit(0).cast("bigint").alias("step"), F.col("again").alias("n"))))
    rows = pieces.select(SITE, "lo", "hi", all_steps.alias("w")).select(SITE, "lo", "hi", F.inline("w"))
    return rows.where(F.col("n") > 0).groupBy(SITE, F.col("step").alias("step_seconds")).agg(
        F.sum("n").alias("n"), F.timestamp_seconds(F.min("lo")).alias("first_ts"), F.timestamp_seconds(F.max("hi")).alias("last_ts"))


def timeline_summary(df: DataFrame, tolerance=1.5) -> DataFrame:
    """Rows, range, common step, span, gaps and the largest gap of each site, in one pass."""
    counted = step_counts(df).withColumn("expected_seconds", F.max_by(
        "step_seconds", F.when(F.col("step_seconds").isNotNull(), F.struct(F.col("n"), -F.col("step_seconds")))
    ).over(Window.partitionBy(SITE)))
    step = F.col("step_seconds")
    gap = step > F.col("expected_seconds") * F.lit(tolerance)
    return counted.groupBy(SITE, "expected_seconds").agg(
        F.sum("n").alias("records"), F.min("first_ts").alias("start"), F.max("last_ts").alias("end"),
        F.sum(step * F.col("n")).alias("span_seconds"),
        F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0)).alias("gaps_detected"),
        F.max(F.when(gap, step)).alias("largest_gap_seconds"))


def temporal_completeness(df: DataFrame, tolerance=1.5) -> DataFrame:
    """Expected and actual rows of the span, gaps and the largest gap of each site with two rows or more."""
    out = timeline_summary(df, tolerance).where(F.col("expected_seconds").isNotNull()).select(
        SITE, "expected_seconds", "span_seconds", F.col("records").alias("actual_records"), "gaps_detected", "largest_gap_seconds")
    wanted = F.floor(F.try_divide("span_seconds", "expected_seconds")) + F.lit(1)
    return out.withColumn("expected_records", wanted).withColumns({
        "temporal_completeness_pct": F.try_divide("actual_records", "expected_records")
        * F.lit(100.0),
        "missing_intervals": F.col("expected_records") - F.col("actual_records")})


def duplicate_timestamps(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each time."""
    return distinct_times(df).groupBy(SITE).agg(
        F.sum("copies").alias("rows"), F.sum(F.col("copies") - 1).alias("duplicates"))


def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, range, granularity and completeness against the expected rows per day."""
    base = name_steps(timeline_summary(df).withColumnRenamed("expected_seconds", "step_seconds")).select(
        SITE, "records", "start", "end", "granularity",
        F.lit(len([c for c in df.columns if c not in (SITE, TS, DAY)])).alias("columns"),
        (F.floor((F.unix_seconds("end") - F.unix_seconds("start")) / 86400) + 1).alias("duration_days"))
    per_day = F.lit(None).cast("bigint")
    for name, count in EXPECTED_PER_DAY.items():
        per_day = F.when(F.col("granularity") == name, F.lit(count)).otherwise(per_day)
    out = base.withColumn("granularity", F.coalesce("granularity", F.lit("insufficient_data")))
    return out.withColumn("expected_records", F.col("duration_days") * per_day).withColumn(
        "completeness_pct", F.try_divide("records", "expected_records") * F.lit(100.0))
