"""Per-site reports joined from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import weather
from ..schema import SITE, TS


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Total, mean, best and worst time of a forecast; the earlier time wins a tie."""
    v = "predicted_production"
    return forecast.groupBy(SITE).agg(
        F.sum(v).alias("forecast_total"), F.avg(v).alias("forecast_average"),
        F.min_by(TS, F.struct(-F.col(v), F.col(TS))).alias("best_ts"),
        F.min_by(TS, F.struct(F.col(v), F.col(TS))).alias("worst_ts"))


def weather_report(merged: DataFrame, forecast: DataFrame | None = None) -> DataFrame:
    """Strongest correlation, best temperature range, efficiency and forecast of each site."""
    period = merged.groupBy(SITE).agg(F.min(TS).alias("start"), F.max(TS).alias("end"),
                                      F.count(F.lit(1)).alias("data_points"))
    r = weather.weather_correlations(merged)
    strongest = (r.withColumn("_k", F.row_number().over(Window.partitionBy(SITE).orderBy(
        F.abs("r").desc(), "parameter"))).where("_k = 1")
        .select(SITE, F.col("parameter").alias("top_parameter"), F.col("r").alias("top_r"),
                F.col("strength").alias("top_strength")))
    warm = (weather.optimal_conditions(merged, ("temperature",)).where("range = 'optimal'")
            .select(SITE, F.col("p25").alias("best_temp_low"), F.col("p75").alias("best_temp_high"),
                    F.col("mean").alias("best_temp_mean")))
    efficiency = weather.efficiency_summary(weather.weather_factors(merged))
    out = period.join(strongest, SITE, "left").join(warm, SITE, "left").join(
        efficiency, SITE, "left")
    if forecast is not None:
        out = out.join(forecast_summary(forecast), SITE, "left")
    return out
