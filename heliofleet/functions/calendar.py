"""Calendar expressions over a date column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .numeric import col, flag

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
QUARTER_SEASONS = ("Winter", "Spring", "Summer", "Fall")

TIME_FEATURES = ("day_of_year", "day_of_week", "month", "quarter", "week_of_year", "is_weekend",
                 "is_monday", "is_winter", "is_spring", "is_summer", "is_fall")
CYCLES = {"day": ("day_of_year", 365.25), "week": ("day_of_week", 7.0),
          "month": ("month", 12.0), "quarter": ("quarter", 4.0)}
SUMMER_SOLSTICE_DAY = 172


def season(day) -> Column:
    month = F.month(col(day))
    out = None
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name) if out is None else out.when(
            month.isin(*months), name)
    return out


def _label(position: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def month_name(month) -> Column:
    return _label(col(month), MONTH_NAMES)


def quarter_season(quarter) -> Column:
    return _label(col(quarter), QUARTER_SEASONS)


def time_feature_columns(day) -> dict[str, Column]:
    """Mon = 0 for ``day_of_week``; ``week_of_year`` is the ISO week."""
    day = col(day)
    weekday, month = F.weekday(day), F.month(day)
    out = {
        "day_of_year": F.dayofyear(day),
        "day_of_week": weekday,
        "month": month,
        "quarter": F.quarter(day),
        "week_of_year": F.weekofyear(day),
        "is_weekend": flag(weekday >= 5),
        "is_monday": flag(weekday == 0),
    }
    for name, months in SEASONS.items():
        out[f"is_{name.lower()}"] = flag(month.isin(*months))
    return out


def cyclical_columns(day, cycles=("day", "week", "month", "quarter")) -> dict[str, Column]:
    parts = time_feature_columns(day)
    out = {}
    for name in cycles:
        part, period = CYCLES[name]
        angle = F.lit(2 * math.pi) * parts[part] / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def solstice_columns(day) -> dict[str, Column]:
    away = F.abs(F.dayofyear(col(day)) - F.lit(SUMMER_SOLSTICE_DAY))
    distance = F.least(away, F.lit(365) - away)
    return {"days_from_summer_solstice": distance,
            "seasonal_strength": F.lit(1.0) - distance / F.lit(182.5)}


def approximate_daylight(day) -> Column:
    """12 h plus a 4 h yearly swing that crosses zero on day 81."""
    return F.lit(12.0) + F.lit(4.0) * F.sin(
        F.lit(2 * math.pi) * (F.dayofyear(col(day)) - F.lit(81)) / F.lit(365.0))
