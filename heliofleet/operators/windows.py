"""Rolling and lagged columns over a site's days.

All columns of one call are built on the same ``partitionBy(site_id).orderBy(day)``, so
Spark plans one exchange and one sort for them. Frames count rows, which are days once
gaps are filled. A site has one row per day here, so a partition is bounded by the calendar.

A window expression used twice inside one column is evaluated twice, so columns built from
several rolling values come in two steps: the rolling values first, arithmetic on them next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import ratio, ratio_or
from ..schema import CONSUMPTION, DAY, ENERGY, PRODUCTION, SITE

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def by_day():
    return Window.partitionBy(SITE).orderBy(DAY)


def trailing(n: int):
    return by_day().rowsBetween(-(n - 1), 0)


def rolling_median(c, n: int) -> Column:
    """Median of the last ``n`` rows. ``percentile`` is the one median that accepts an ordered
    frame; its cost grows with ``n``, which is 30 at most here."""
    return F.percentile(c, F.lit(0.5)).over(trailing(n))


def _merged(a: dict, b: dict, back: int) -> dict:
    """Figures of runs of rows, each joined to the run that ends ``back`` rows earlier.

    Squares are summed around the means of the runs, so large values cancel nothing.
    """
    out, back = {k: v.copy() for k, v in a.items()}, min(back, len(a["n"]))
    here = {k: v[back:] for k, v in a.items()}
    before = {k: v[:len(v) - back] for k, v in b.items()}
    n, m = here["n"], before["n"]
    apart = np.where((n > 0) & (m > 0), here["total"] / np.maximum(n, 1) - before["total"] / np.maximum(m, 1), 0.0)
    out["squares"][back:] += before["squares"] + apart * apart * (n * m / np.maximum(n + m, 1))
    for k in ("n", "ordinary", "total"):
        out[k][back:] += before[k]
    out["low"][back:] = np.fmin(here["low"], before["low"])
    out["high"][back:] = np.maximum(here["high"], before["high"])
    return out


def trailing_figures(values: np.ndarray, known: np.ndarray, windows) -> dict[int, dict]:
    """n, mean, std, min and max of the last ``w`` rows at each row, for each w of ``windows``.

    Runs of 1, 2, 4, .. rows are merged from two of half the length, a window from the runs that
    make it up (7 = 4 + 2 + 1): a row costs some merges, not the rows of its frames. NaN counts as
    the largest value, as in Spark.
    """
    whole = values.dtype.kind in "iu"
    most, least = (np.iinfo(values.dtype).max, np.iinfo(values.dtype).min) if whole else (np.inf, -np.inf)
    plain = known if whole else known & ~np.isnan(values)
    run = {"n": known.astype(float), "ordinary": plain.astype(float), "squares": np.zeros(len(values)),
           "total": np.where(known, values, 0).astype(float), "low": np.where(plain, values, most),
           "high": np.where(known, values, least)}
    found, length = {}, 1
    with np.errstate(all="ignore"):  # infinite and NaN readings make NaN figures
        while length <= max(windows):
            for w in windows:
                if w & length:  # the shorter runs end at the row, the longer ones lie before them
                    found[w] = _merged(found[w], run, w & (length - 1)) if w in found else run
            run, length = _merged(run, run, length), 2 * length
        for w, f in found.items():
            f = dict(f, mean=f["total"] / f["n"], std=np.sqrt(f["squares"] / (f["n"] - 1)))
            f["min"] = f["low"] if whole else np.where(f["ordinary"] > 0, f["low"], np.nan)
            found[w] = dict(f, max=f["high"])
    return found


def rolling_stats(df: DataFrame, cols=ENERGY, windows=(7, 14, 30), stats=("mean", "std")):
    """``<column>_rolling_<stat>_<n>d`` for each column, window and statistic.

    Spark reads a sliding frame again for each row, so a site's days are gathered by the partitioning
    that the other windows share, and numpy merges their figures. Decimals keep Spark's frames.
    """
    cols, at = list(cols), [f"_c{i}" for i in range(len(cols))]
    kinds = [df.schema[c].dataType for c in cols]
    if not all(isinstance(k, (T.IntegralType, T.DoubleType, T.FloatType)) for k in kinds):
        return df.withColumns({
            f"{c.removesuffix('_kwh')}_rolling_{s}_{n}d": ROLLING[s](c).over(trailing(n))
            for c in cols for n in windows for s in stats})
    names = [(i, n, s) for i in range(len(cols)) for n in windows for s in stats]
    out = T.StructType([T.StructField(f"{cols[i].removesuffix('_kwh')}_rolling_{s}_{n}d",
                                      kinds[i] if s in ("min", "max") else T.DoubleType()) for i, n, s in names])
    # figures take several times the room of the days, so few sites go to Python at once
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    arrow = list(to_arrow_schema(out))
    fewest = {"mean": 1, "std": 2, "min": 1, "max": 1}

    @F.arrow_udf(T.ArrayType(out))
    def figures(sites: pa.Array) -> pa.Array:
        found = [[pa.array([], t.type)] for t in arrow]
        for site in sites:
            rows = site.values
            order = pa.compute.array_sort_indices(rows.field("_at"), null_placement="at_start").to_numpy()
            of = []
            for c in at:
                column = rows.field(c)
                values = column.fill_null(0).to_numpy(zero_copy_only=False)[order]
                of.append(trailing_figures(values, column.is_valid().to_numpy(zero_copy_only=False)[order], windows))
            for column, (i, n, s) in zip(found, names):
                f, placed = of[i][n], np.empty(len(order), of[i][n][s].dtype)
                none = np.empty(len(order), bool)
                placed[order], none[order] = f[s], f["n"] < fewest[s]
                column.append(pa.array(placed, mask=none).cast(column[0].type))
        ends = pa.array(np.cumsum([0, *(len(site.values) for site in sites)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.concat_arrays(c) for c in found], fields=arrow))

    kept = [c for c in df.columns if c != SITE]
    sites = df.groupBy(SITE).agg(F.collect_list(F.struct(*kept)).alias("_rows"))
    asked = F.transform("_rows", lambda r: F.struct(r[DAY].alias("_at"), *[r[c].alias(n) for c, n in zip(cols, at)]))
    told = sites.withColumn("_told", figures(asked))
    both = told.select(SITE, F.explode(F.arrays_zip("_rows", "_told")).alias("_r"))
    return both.select(*[F.col(SITE) if c == SITE else F.col("_r._rows")[c].alias(c) for c in df.columns],
                       *[F.col("_r._told")[f.name].alias(f.name) for f in out])


def temporal_rolling(df: DataFrame, target=PRODUCTION, windows=(7, 14, 30), extra=None):
    """Mean, deviation, median, minimum, maximum and range; ``extra`` columns are added in the
    same projection."""
    out = {}
    for n in windows:
        over = trailing(n)
        out[f"rolling_mean_{n}d"] = F.avg(target).over(over)
        out[f"rolling_std_{n}d"] = F.stddev_samp(target).over(over)
        out[f"rolling_median_{n}d"] = rolling_median(target, n)
        out[f"rolling_min_{n}d"] = F.min(target).over(over)
        out[f"rolling_max_{n}d"] = F.max(target).over(over)
    return df.withColumns({**(extra or {}), **out}).withColumns({
        f"rolling_range_{n}d": F.col(f"rolling_max_{n}d") - F.col(f"rolling_min_{n}d")
        for n in windows})


def strict(agg, c, n: int) -> Column:
    """A rolling value that is NULL until ``n`` non-NULL rows are in the frame."""
    over = trailing(n)
    return F.when(F.count(c).over(over) == n, agg(c).over(over))


def rolling_strict(df: DataFrame, target=PRODUCTION, other=CONSUMPTION) -> DataFrame:
    return df.withColumns({
        "prod_7day_avg": strict(F.avg, target, 7), "prod_30day_avg": strict(F.avg, target, 30),
        "prod_3day_std": strict(F.stddev_samp, target, 3),
        "prod_7day_max": strict(F.max, target, 7), "prod_7day_min": strict(F.min, target, 7),
        "cons_7day_avg": strict(F.avg, other, 7)})


def centered(c, n: int) -> Column:
    """Centred mean, NULL at both ends; an even ``n`` reaches one row further back."""
    ahead = (n - 1) // 2
    over = by_day().rowsBetween(-(n - 1 - ahead), ahead)
    return F.when(F.count(c).over(over) == n, F.avg(c).over(over))


def rolling_centered(df: DataFrame, target=PRODUCTION, windows=(7, 30)) -> DataFrame:
    return df.withColumns({f"centered_mean_{n}d": centered(target, n) for n in windows})


def lag_columns(target=PRODUCTION, steps=(1, 2, 3, 7, 14)) -> dict[str, Column]:
    return {f"{target}_lag_{k}d": F.lag(target, k).over(by_day()) for k in steps}


def change_columns(target=PRODUCTION, changes=(1, 7)) -> dict[str, Column]:
    """Change and % change from lag columns that exist already."""
    out = {}
    for k in changes:
        before = F.col(f"{target}_lag_{k}d")
        delta = F.col(target) - before
        out[f"change_from_{k}d_ago"] = delta
        out[f"pct_change_from_{k}d_ago"] = ratio(delta, before + F.lit(0.01)) * F.lit(100.0)
    return out


def lags(df: DataFrame, target=PRODUCTION, steps=(1, 2, 3, 7, 14), changes=(1, 7)) -> DataFrame:
    df = df.withColumns(lag_columns(target, steps))
    return df.withColumns(change_columns(target, [k for k in changes if k in steps]))


def volatility_trend(df: DataFrame, target=PRODUCTION) -> DataFrame:
    """Weekly deviation, performance against the monthly mean, and the change of both rolling
    means. The trend lags a rolling column: a second window operator on the same ordering."""
    named = {n: f"rolling_mean_{n}d" for n in (7, 30)}
    missing = {c: F.avg(target).over(trailing(n)) for n, c in named.items() if c not in df.columns}
    df = df.withColumns({**missing, "production_volatility": F.stddev_samp(target).over(trailing(7))})
    df = df.withColumns({f"_before_{n}": F.lag(c, n).over(by_day()) for n, c in named.items()})
    out = {"relative_performance": ratio(F.col(target), F.col(named[30]) + F.lit(0.01))}
    for n, c in named.items():
        before = F.col(f"_before_{n}")
        out[f"trend_{n}d"] = ratio(F.col(c) - before, before + F.lit(0.01))
    return df.withColumns(out).drop(*[f"_before_{n}" for n in named])


def efficiency_metrics(df: DataFrame, target=PRODUCTION, n: int = 30) -> DataFrame:
    """Performance against the rolling mean, short volatility and its coefficient."""
    df = df.withColumns({
        "_mean": F.avg(target).over(trailing(n)),
        "efficiency_volatility": F.stddev_samp(target).over(trailing(min(7, n)))})
    return df.withColumns({
        "efficiency_relative_performance": ratio_or(target, "_mean", 1.0),
        "efficiency_cv": ratio_or("efficiency_volatility", "_mean", 0.0)}).drop("_mean")


def seasonal_ratio(df: DataFrame, target=PRODUCTION) -> DataFrame:
    """Value against the site's mean of the same month of year."""
    mean = F.avg(target).over(Window.partitionBy(SITE, F.month(DAY)))
    return df.withColumn("seasonal_ratio", ratio(F.col(target), mean))


def daily_performance(df: DataFrame, target=PRODUCTION, capacity="capacity_factor") -> DataFrame:
    """Value against the site mean, and that times the site's capacity factor (0..1)."""
    out = ratio(F.col(target), F.avg(target).over(Window.partitionBy(SITE)))
    df = df.withColumn("daily_performance_ratio", out)
    if capacity in df.columns:
        df = df.withColumn("efficiency_normalized",
                           F.col("daily_performance_ratio") * F.col(capacity))
    return df
