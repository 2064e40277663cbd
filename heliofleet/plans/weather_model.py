"""Production from hourly weather: a forest per site, trained on its past hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import at_least
from ..operators.merging import merge_weather_hourly
from ..schema import PRODUCTION, SITE, TS
from .site_models import Ensemble, site_predictions

# Least rows to train on, and what a forecast without the column is taken for.
MIN_ROWS = 50
MISSING_WEATHER = {"pressure": 1013.0, "ghi": 400.0, "dni": 300.0}
MEASURED = ("temperature", "humidity", "cloud_cover", "wind_speed", "pressure")
IRRADIANCE = ("ghi", "dni")
TIMES = ("hour", "day_of_year")
FOREST = Ensemble("forest", trees=100, depth=10, min_rows=MIN_ROWS)


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour(TS), "day_of_year": F.dayofyear(TS)})


def weather_impact(production: DataFrame, weather: DataFrame, forecast: DataFrame, model: Ensemble = FOREST) -> DataFrame:
    """Predicted production of the ``forecast`` hours, at least 0, from each site's ``production`` and ``weather``.

    Irradiance counts at sites that have measured it. In the forecast an absent column takes its
    default and a missing value 0. Sites with fewer than MIN_ROWS complete hours have no predictions.
    """
    features = (*MEASURED, *IRRADIANCE, *TIMES)
    past = _timed(merge_weather_hourly(production, weather))
    past = past.select(SITE, TS, PRODUCTION, F.lit(0).alias("is_test"),
                       *[(F.col(c) if c in past.columns else F.lit(None)).cast("double").alias(c) for c in features])
    next_hours = _timed(forecast)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in next_hours.columns
              else F.lit(MISSING_WEATHER.get(c, 0.0)) for c in features}
    asked = next_hours.select(SITE, TS, F.lit(None).cast("double").alias(PRODUCTION), F.lit(1).alias("is_test"),
                              *[e.alias(c) for c, e in filled.items()])
    found = site_predictions(past.unionByName(asked), features, {"forest": model}, stamp=TS, optional=IRRADIANCE)
    told = found.select(SITE, TS, at_least("prediction", 0).alias("predicted_production"))
    shown = [c if c in forecast.columns else F.lit(None).cast("double").alias(c) for c in ("temperature", "cloud_cover", "ghi")]
    return told.join(forecast.select(SITE, TS, *shown), [SITE, TS])
