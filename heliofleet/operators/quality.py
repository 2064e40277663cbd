"""Completeness, integrity rules, outliers and the quality score.

Rule counts come from one aggregate per table and are turned to rows afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import clip, descending_band, ratio
from ..schema import CONSUMPTION, DAY, ENERGY, EXPORT, IMPORT, PRODUCTION, SITE, TS
from .quantiles import attach_per_site, site_quantiles, value_counts
from .timeline import duplicate_timestamps, granularity

BALANCE_TOLERANCE_KWH = 0.1
HIGH_READING_KWH = 0.5
IQR_FACTOR, IQR_MIN_VALUES = 1.5, 4
SCORE_LIMITS = (90, 75, 60)
SCORE_BANDS = ("Excellent", "Good", "Fair", "Poor")


def _present(df, cols):
    return [c for c in (cols or ENERGY) if c in df.columns]


def _counts(df, cols):
    return df.groupBy(SITE).agg(F.count(F.lit(1)).alias("rows"),
                                *[F.count(c).alias(c) for c in cols])


def completeness(df: DataFrame, cols=None) -> DataFrame:
    """Present and missing cells per site and column, and over all columns (``*``)."""
    cols = _present(df, cols)
    total = sum((F.col(c) for c in cols), F.lit(0))
    rows = [F.struct(F.lit(c).alias("column"), F.col("rows").alias("cells"),
                     F.col(c).alias("present")) for c in cols]
    rows.append(F.struct(F.lit("*").alias("column"), (F.col("rows") * len(cols)).alias("cells"),
                         total.alias("present")))
    return (_counts(df, cols).select(SITE, F.inline(F.array(*rows)))
            .withColumns({"missing": F.col("cells") - F.col("present"),
                          "completeness_pct": ratio("present", "cells") * F.lit(100.0)}))


def missing_values(df: DataFrame, cols=None) -> DataFrame:
    """Missing cells per column, the action they call for and the site's worst column."""
    cols = _present(df, cols)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     (F.col("rows") - F.col(c)).alias("missing"),
                     (ratio(F.col("rows") - F.col(c), "rows") * F.lit(100.0)).alias("missing_pct"))
            for i, c in enumerate(cols)]
    listed = _counts(df, cols).select(SITE, F.array(*rows).alias("r"))
    worst = F.reduce(
        "r", F.col("r")[0], lambda a, b: F.when(b.missing > a.missing, b).otherwise(a))
    action = (F.when(F.col("missing_pct") > 50, "drop").when(F.col("missing_pct") > 10,
                                                            "investigate").otherwise("keep"))
    return (listed.withColumn("w", worst).select(SITE, "w", F.inline("r"))
            .select(SITE, "column", "missing", "missing_pct", action.alias("action"),
                    F.when(F.col("w.missing") > 0, F.col("w.column")).alias("worst_column"),
                    F.col("w.missing_pct").alias("worst_column_pct")))


def outlier_bounds(df: DataFrame, cols=None) -> DataFrame:
    """Interquartile fences per site and column; columns under four values have none."""
    q = site_quantiles(df, _present(df, cols), (0.25, 0.75), IQR_MIN_VALUES)
    spread = (F.col("q1") - F.col("q0")) * F.lit(IQR_FACTOR)
    return q.select(SITE, "column", "n", F.col("q0").alias("p25"), F.col("q1").alias("p75"),
                    (F.col("q0") - spread).alias("lower"), (F.col("q1") + spread).alias("upper"))


def iqr_outlier_counts(df: DataFrame, cols=None) -> DataFrame:
    """Outliers per site and column, counted on merged values rather than on raw rows."""
    cols = _present(df, cols)
    bounds = outlier_bounds(df, cols)
    salt = F.pmod(F.xxhash64("value"), F.lit(8)).cast("int")
    spread = value_counts(df, cols).withColumn("_salt", salt)
    fences = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return (spread.join(fences.drop("n"), [SITE, "column", "_salt"])
            .groupBy(SITE, "column", "p25", "p75", "lower", "upper")
            .agg(F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("outliers")))


def iqr_outliers(df: DataFrame, cols=None) -> DataFrame:
    """The outlying readings themselves, one row per site, time and column."""
    cols = _present(df, cols)
    stamp = TS if TS in df.columns else DAY
    bounds = outlier_bounds(df, cols).groupBy(SITE).agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("column"), F.struct("lower", "upper")))).alias("fences"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
    rows = attach_per_site(df.select(SITE, stamp, *cols), bounds, spread=stamp).select(
        SITE, stamp, "fences", F.inline(pairs))
    fence = F.try_element_at("fences", F.col("column"))
    return (rows.withColumn("f", fence)
            .where((F.col("value") < F.col("f.lower")) | (F.col("value") > F.col("f.upper")))
            .select(SITE, stamp, "column", "value", F.col("f.lower").alias("lower"),
                    F.col("f.upper").alias("upper")))


def _rule_counts(df):
    p, c, x, i = (F.col(n) for n in (PRODUCTION, CONSUMPTION, EXPORT, IMPORT))
    imbalance = F.abs((p - c) - (x - i))
    return {
        "negative_production": F.count_if(p < 0), "excess_export": F.count_if(x > p),
        "energy_balance": F.count_if(imbalance > BALANCE_TOLERANCE_KWH),
        **{f"negative_{n.split('_')[0]}": F.count_if(F.col(n) < 0)
           for n in (CONSUMPTION, EXPORT, IMPORT)},
        "high_production": F.count_if(p > HIGH_READING_KWH),
        "missing_values": sum((F.count_if(F.col(n).isNull()) for n in ENERGY), F.lit(0)),
    }


# Rules that count as an issue or a warning of the score; the others are notes.
ISSUES = ("negative_production", "excess_export")
WARNINGS = ("energy_balance",)


def _level(rule):
    return "issue" if rule in ISSUES else "warning" if rule in WARNINGS else "note"


def integrity(df: DataFrame) -> DataFrame:
    """One row per site and rule with the number of records that break it."""
    rules = _rule_counts(df)
    counted = df.groupBy(SITE).agg(*[c.alias(r) for r, c in rules.items()])
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(_level(r)).alias("level"),
                              F.col(r).cast("bigint").alias("records")) for r in rules])
    out = counted.select(SITE, F.inline(rows))
    outliers = iqr_outlier_counts(df).select(
        SITE, F.concat(F.lit("outliers:"), F.col("column")).alias("rule"),
        F.lit("warning").alias("level"), F.col("outliers").cast("bigint").alias("records"))
    copies = duplicate_timestamps(df).select(
        SITE, F.lit("duplicate_timestamps").alias("rule"), F.lit("note").alias("level"),
        F.col("duplicates").alias("records"))
    return out.unionByName(outliers).unionByName(copies)


def quality_score(df: DataFrame, cols=None) -> DataFrame:
    """100 - missing % / 2 - 10 per kind of issue - 2 per kind of warning, in 0..100.

    Cells and row rules come from one pass; only the outlier kinds need the value counts.
    """
    cols = _present(df, cols)
    rules = {r: c for r, c in _rule_counts(df).items() if r in ISSUES + WARNINGS}
    whole = df.groupBy(SITE).agg(
        (F.count(F.lit(1)) * len(cols)).alias("cells"),
        sum((F.count(c) for c in cols), F.lit(0)).alias("present"),
        *[c.alias(r) for r, c in rules.items()])
    odd = iqr_outlier_counts(df, cols).groupBy(SITE).agg(
        F.count_if(F.col("outliers") > 0).alias("odd_columns"))

    def kinds(names):
        return sum(((F.col(r) > 0).cast("bigint") for r in names), F.lit(0))

    out = whole.join(odd, SITE, "left").select(
        SITE, "cells", (F.col("cells") - F.col("present")).alias("missing"),
        (ratio("present", "cells") * F.lit(100.0)).alias("completeness_pct"),
        kinds(ISSUES).alias("issues"),
        (kinds(WARNINGS) + F.coalesce("odd_columns", F.lit(0))).alias("warnings"))
    score = (F.lit(100.0) - ratio("missing", "cells") * F.lit(100.0) * F.lit(0.5)
             - F.col("issues") * F.lit(10.0) - F.col("warnings") * F.lit(2.0))
    return (out.withColumn("quality_score", clip(score, 0, 100))
            .withColumn("assessment", descending_band("quality_score", SCORE_LIMITS, SCORE_BANDS))
            .drop("cells"))


def source_summary(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows, range, granularity and completeness per site and source."""
    def one(name, df):
        stamp = TS if TS in df.columns else DAY
        cols = _present(df, None)
        filled = sum((F.count(c) for c in cols), F.lit(0))
        base = df.groupBy(SITE).agg(
            F.count(F.lit(1)).alias("records"), F.min(F.to_date(stamp)).alias("start_day"),
            F.max(F.to_date(stamp)).alias("end_day"),
            (ratio(filled, F.count(F.lit(1)) * len(cols)) * F.lit(100.0))
            .alias("completeness_pct"))
        grain = granularity(df).select(SITE, "granularity")
        return base.join(grain, SITE, "left").withColumn("source", F.lit(name))

    frames = [one(n, d) for n, d in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def feature_readiness(df: DataFrame, value=PRODUCTION) -> DataFrame:
    """Whether a site has enough days for lags and rolling windows, and what is missing."""
    cols = _present(df, None)
    worst = F.greatest(*[ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))) for c in cols])
    missing_target = F.lit(int(value not in df.columns))
    out = df.groupBy(SITE).agg(F.count(F.lit(1)).alias("days"),
                               (worst * F.lit(100.0)).alias("worst_missing_pct"))
    return out.withColumns({
        "valid": F.lit(1) - missing_target, "short_rolling": (F.col("days") < 30).cast("int"),
        "short_lags": (F.col("days") < 14).cast("int"),
        "high_missing": (F.col("worst_missing_pct") > 10).cast("int"),
        "has_consumption": F.lit(int(CONSUMPTION in df.columns))})
