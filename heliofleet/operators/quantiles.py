"""Exact quantiles of raw readings without one task per site.

Daily tables are bounded by the calendar and use the built-in ``percentile``. Raw readings
are not: one site may hold a third of them. Here equal values are first merged to counts
(map-side), the merged rows are spread by ``(site, column, value)``, a logarithmic bucket
histogram finds the bucket of each wanted rank, and only those buckets are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import SITE

BUCKETS_PER_OCTAVE = 64
TINY = 1e-12


def value_counts(df: DataFrame, cols) -> DataFrame:
    """``site_id, column, value, n`` for all non-NULL values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    return (df.select(SITE, F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy(SITE, "column", "value").agg(F.count(F.lit(1)).alias("n")))


def _bucket(value):
    size = F.log2(F.abs(value) + F.lit(TINY)) - F.lit(-40.0)
    magnitude = F.floor(size * F.lit(BUCKETS_PER_OCTAVE)).cast("int") + F.lit(1)
    return F.when(value == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude)


def site_quantiles(df: DataFrame, cols, probs, min_count=1) -> DataFrame:
    """One row per site and column: ``n`` and one linear-interpolated quantile per
    probability, named ``q0``, ``q1``, ..."""
    counted = value_counts(df, cols).withColumn("b", _bucket(F.col("value")))
    key = [SITE, "column"]
    by_key = Window.partitionBy(*key)
    running = by_key.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (counted.groupBy(*key, "b").agg(F.sum("n").alias("in_bucket"))
                 .withColumns({"total": F.sum("in_bucket").over(by_key),
                               "below": F.sum("in_bucket").over(running) - F.col("in_bucket")}))
    ranks = F.array(*[F.struct(
        F.lit(pos).alias("pos"), F.lit(end).alias("end"),
        (F.floor if end == 0 else F.ceil)(F.lit(float(p)) * (F.col("total") - 1)).alias("rank"))
        for pos, p in enumerate(probs) for end in (0, 1)])
    wanted = (histogram.select(*key, "b", "total", "below", "in_bucket", F.inline(ranks))
              .where((F.col("rank") >= F.col("below"))
                     & (F.col("rank") < F.col("below") + F.col("in_bucket"))
                     & (F.col("total") >= min_count)))
    buckets = wanted.groupBy(*key, "b").agg(
        F.first("below").alias("below"), F.first("total").alias("total"),
        F.collect_list(F.struct("pos", "end", "rank")).alias("ranks"))
    inside = Window.partitionBy(*key, "b").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = (counted.join(buckets, [*key, "b"])
              .withColumn("upto", F.col("below") + F.sum("n").over(inside)))
    hits = (placed.select(*key, "value", "upto", "n", "total", F.inline("ranks"))
            .where((F.col("rank") < F.col("upto"))
                   & (F.col("rank") >= F.col("upto") - F.col("n"))))

    def interpolated(pos, p):
        lo = F.max(F.when((F.col("pos") == pos) & (F.col("end") == 0), F.col("value")))
        hi = F.max(F.when((F.col("pos") == pos) & (F.col("end") == 1), F.col("value")))
        place = F.lit(float(p)) * (F.max("total") - F.lit(1))
        return lo + (hi - lo) * (place - F.floor(place))

    return hits.groupBy(*key).agg(
        F.max("total").alias("n"),
        *[interpolated(pos, p).alias(f"q{pos}") for pos, p in enumerate(probs)])


def attach_per_site(df: DataFrame, per_site: DataFrame, salts=8, spread="ts") -> DataFrame:
    """Left-join a small per-site table to raw rows.

    The per-site table grows with the fleet, so it is not forced into a broadcast: the
    planner does that below its size limit. Beyond it the rows of a site are spread over
    ``salts`` partitions and the per-site row is repeated as often.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = per_site.withColumn(
        "_salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    return salted.join(repeated, [SITE, "_salt"], "left").drop("_salt")
