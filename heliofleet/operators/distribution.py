"""Histograms, box statistics, trend lines and correlation matrices."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import correlation, correlation_strength
from ..schema import DAY, PRODUCTION, SITE

WHISKER = 1.5


def histogram(df: DataFrame, value=PRODUCTION, bins=30) -> DataFrame:
    """Equal-width bins between the site's minimum and maximum; the maximum belongs to the
    last bin, empty bins are listed."""
    w = Window.partitionBy(SITE)
    ranged = df.where(F.col(value).isNotNull()).select(
        SITE, F.col(value).alias("v"), F.min(value).over(w).alias("lo"),
        F.max(value).over(w).alias("hi"))
    # one distinct value: numpy widens the range by half a unit on both sides
    flat = F.col("lo") == F.col("hi")
    ranged = ranged.select(
        SITE, "v", F.when(flat, F.col("lo") - F.lit(0.5)).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + F.lit(0.5)).otherwise(F.col("hi")).alias("hi"))
    slot = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins))
    counted = (ranged.withColumn("bin", F.least(slot, F.lit(bins - 1)))
               .groupBy(SITE, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n")))
    found = counted.groupBy(SITE, "lo", "hi").agg(F.map_from_entries(
        F.collect_list(F.struct("bin", "n"))).alias("m"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (found.select(SITE, "lo", "hi", "m", F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
            .select(SITE, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("count")))


def box_stats(daily: DataFrame, value=PRODUCTION) -> DataFrame:
    """Quartiles, whiskers and outliers by month of year."""
    month = F.month(DAY).alias("month")
    w = Window.partitionBy(SITE, "month")
    q = F.percentile("v", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).over(w)
    rows = (daily.select(SITE, month, F.col(value).alias("v")).where(F.col("v").isNotNull())
            .withColumn("q", q))
    low, high = F.col("q")[0], F.col("q")[2]
    spread = (high - low) * F.lit(WHISKER)
    inside = (F.col("v") >= low - spread) & (F.col("v") <= high + spread)
    return rows.groupBy(SITE, "month").agg(
        F.max(low).alias("q1"), F.max(F.col("q")[1]).alias("median"), F.max(high).alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))


def trend_line(df: DataFrame, x, y=PRODUCTION) -> DataFrame:
    """Least-squares line and Pearson r of ``y`` on ``x`` per site, over complete pairs."""
    pairs = df.select(SITE, F.col(x).alias("x") if isinstance(x, str) else x.alias("x"),
                      F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return pairs.groupBy(SITE).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        correlation("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson r of each pair of columns per site, highest first within the site."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(a, b).alias("r"))
                      for a, b in combinations(cols, 2)])
    out = df.groupBy(SITE).agg(pairs.alias("p")).select(SITE, F.inline("p"))
    place = F.row_number().over(Window.partitionBy(SITE).orderBy(
        F.col("r").desc_nulls_last(), "a", "b"))
    return out.withColumn("rank", place)


def correlations_with(df: DataFrame, cols, target=PRODUCTION) -> DataFrame:
    """Pearson r of the target with each column over pairwise complete rows, with its band."""
    pairs = F.array(*[F.struct(F.lit(c).alias("parameter"), correlation(target, c).alias("r"))
                      for c in cols])
    return (df.groupBy(SITE).agg(pairs.alias("p")).select(SITE, F.inline("p"))
            .where(F.col("r").isNotNull() & ~F.isnan("r"))
            .withColumn("strength", correlation_strength("r")))
