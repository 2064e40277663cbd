"""Quantiles of any range of days from small sketches, kept per site and day.

A sketch has a bounded size whatever it has seen, and sketches merge: a month or a fleet is
answered from its days without reading a value again. Quantiles are approximate: the rank of
an answer is off by at most about RANK_ERROR of all values. The exact ``quantiles`` stay the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import DAY, SITE, TS

K = 400
#: Normalised rank error of a sketch of size K, for one quantile, at 99 % confidence, rounded up.
RANK_ERROR = 0.01


def daily_sketches(df: DataFrame, cols, k: int = K) -> DataFrame:
    """site_id, day, column, n and sketch, for the values that are present."""
    day = F.col(DAY) if DAY in df.columns else F.to_date(TS)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    rows = df.select(SITE, day.alias(DAY), F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(SITE, DAY, "column").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by=(SITE, "column"), k: int = K) -> DataFrame:
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def range_quantiles(sketches: DataFrame, probs, first_day=None, last_day=None, by=(SITE, "column")) -> DataFrame:
    """``by``, n and q0, q1, ... of the days from ``first_day`` to ``last_day``."""
    if first_day is not None:
        sketches = sketches.where(F.col(DAY) >= F.lit(first_day).cast("date"))
    if last_day is not None:
        sketches = sketches.where(F.col(DAY) <= F.lit(last_day).cast("date"))
    whole = merged_sketches(sketches, by)
    return whole.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])


def rank_errors(df: DataFrame, quantiles: DataFrame, column: str, probs, by=(SITE,)) -> DataFrame:
    """``by``, prob, n and rank_error: how far the share of values up to each answer is from the wanted one.

    Values equal to the answer take up a span of ranks; within it the error is 0.
    """
    asked = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(f"q{i}").alias("q")) for i, p in enumerate(probs)])
    answers = quantiles.where(F.col("column") == column).select(*by, asked.alias("asked"))
    values = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    pairs = values.join(answers, list(by)).select(*by, "v", "m", F.inline("asked"))
    ranks = pairs.groupBy(*by, "prob").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("v") < F.col("q"), F.col("m")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("q"), F.col("m")).otherwise(0)).alias("upto"))
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    off = F.when(F.col("prob") < low, low - F.col("prob")).when(F.col("prob") > high, F.col("prob") - high).otherwise(F.lit(0.0))
    return ranks.select(*by, "prob", "n", off.alias("rank_error"))
