"""Null- and zero-aware arithmetic (ANSI mode raises on a zero divisor)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, low, high) -> Column:
    """``greatest``/``least`` skip NULL, so a missing value is kept missing by hand."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def at_least(c, low) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), c))


def at_most(c, high) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), c))


def ratio(num, den) -> Column:
    """NULL on a zero divisor."""
    return F.try_divide(col(num), col(den))


def ratio_or(num, den, other) -> Column:
    """``other`` on a zero divisor, NULL only when an input is NULL."""
    num, den = col(num), col(den)
    return F.when(den == 0, F.lit(float(other))).otherwise(F.try_divide(num, den))


def positive_ratio(num, den, other=0.0) -> Column:
    """``num/den`` where the divisor is positive, else ``other``."""
    num, den = col(num), col(den)
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(other))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def flag(cond) -> Column:
    return cond.cast("int")


def right_closed_bin(c, edges, labels, include_lowest=False) -> Column:
    """Label of the interval ``(lo, hi]`` holding the value; the lowest edge is in no bin
    unless ``include_lowest``."""
    c = col(c)
    out = None
    for pos, (lo, hi, label) in enumerate(zip(edges[:-1], edges[1:], labels)):
        lower = (c >= lo) if include_lowest and pos == 0 else (c > lo)
        cond = lower & (c <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def descending_band(c, limits, labels) -> Column:
    """First label whose limit is reached (``>=``); the last label is the remainder."""
    c = col(c)
    out = None
    for limit, label in zip(limits, labels[:-1]):
        out = (F.when(c >= limit, F.lit(label)) if out is None
               else out.when(c >= limit, F.lit(label)))
    return F.when(c.isNotNull(), out.otherwise(F.lit(labels[-1])))


def ascending_band(c, limits, labels) -> Column:
    """First label whose limit is not reached (``<``); the last label is the remainder."""
    c = col(c)
    out = None
    for limit, label in zip(limits, labels[:-1]):
        out = (F.when(c < limit, F.lit(label)) if out is None
               else out.when(c < limit, F.lit(label)))
    return F.when(c.isNotNull(), out.otherwise(F.lit(labels[-1])))


CORRELATION_LIMITS = (0.8, 0.6, 0.4, 0.2)
CORRELATION_LABELS = ("Very Strong", "Strong", "Moderate", "Weak", "Very Weak")


def correlation_strength(r) -> Column:
    return descending_band(F.abs(col(r)), CORRELATION_LIMITS, CORRELATION_LABELS)


def correlation(a, b):
    """Pearson's r over the rows that have both; NULL where either is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    spread = F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(spread))
