"""Solar geometry and climate class as column expressions.

Angles are degrees, hours are local clock hours (solar time is taken as clock time).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .numeric import ascending_band, col

SOLAR_CONSTANT = 1361.0
EARTH_TILT = 23.45
MAX_AIR_MASS = 10.0

# Climate bands by absolute latitude.
CLIMATE_LIMITS = (23.5, 35.0, 50.0)
CLOUD_FACTORS = (0.7, 0.8, 0.75, 0.6)
HUMIDITY_FACTORS = (0.8, 0.6, 0.5, 0.4)
SEASONAL_VARIATIONS = (0.1, 0.3, 0.5, 0.8)
CLIMATE_NAMES = ("Tropical", "Subtropical", "Temperate", "Subarctic/Subantarctic",
                 "Arctic/Antarctic")
CLIMATE_NAME_LIMITS = (23.5, 35.0, 50.0, 66.5)
CLIMATE_CODES = {"Desert": 1.0, "Arid": 0.9, "Subtropical": 0.8, "Temperate": 0.7,
                 "Continental": 0.6, "Oceanic": 0.5, "Arctic": 0.3}
DEFAULT_CLIMATE_CODE = 0.7


def climate_columns(latitude) -> dict[str, Column]:
    size = F.abs(col(latitude))
    name = ascending_band(size, CLIMATE_NAME_LIMITS, CLIMATE_NAMES)
    code = F.lit(DEFAULT_CLIMATE_CODE)
    for label, value in CLIMATE_CODES.items():
        code = F.when(name == label, F.lit(value)).otherwise(code)
    return {
        "climate_type": name,
        "climate_type_encoded": code,
        "cloud_factor": ascending_band(size, CLIMATE_LIMITS, CLOUD_FACTORS),
        "humidity_factor": ascending_band(size, CLIMATE_LIMITS, HUMIDITY_FACTORS),
        "seasonal_variation": ascending_band(size, CLIMATE_LIMITS, SEASONAL_VARIATIONS),
        "atmospheric_transmission": F.lit(0.75) - size * F.lit(0.002),
    }


def declination(day_of_year) -> Column:
    return F.lit(EARTH_TILT) * F.sin(
        F.radians(F.lit(360.0) * (F.lit(284) + col(day_of_year)) / F.lit(365.0)))


def daylight_hours(latitude, day_of_year) -> Column:
    """The clamp covers polar day and night."""
    cos_h = -F.tan(F.radians(col(latitude))) * F.tan(F.radians(declination(day_of_year)))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_h))
    return F.lit(2.0) * F.degrees(F.acos(bounded)) / F.lit(15.0)


def sunrise_hour(latitude, day_of_year) -> Column:
    return F.lit(12.0) - daylight_hours(latitude, day_of_year) / F.lit(2.0)


def sunset_hour(latitude, day_of_year) -> Column:
    return F.lit(12.0) + daylight_hours(latitude, day_of_year) / F.lit(2.0)


def elevation(latitude, day_of_year, clock_hour) -> Column:
    """Degrees above the horizon, 0 at night."""
    lat = F.radians(col(latitude))
    decl = F.radians(declination(day_of_year))
    angle = F.radians(F.lit(15.0) * (col(clock_hour) - F.lit(12.0)))
    sine = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))
    return F.greatest(F.lit(0.0), F.degrees(F.asin(bounded)))


def irradiance(elevation_deg, transmission) -> Column:
    """Clear-sky W/m2 on the horizontal for a given elevation."""
    sine = F.sin(F.radians(col(elevation_deg)))
    air_mass = F.least(F.try_divide(F.lit(1.0), sine), F.lit(MAX_AIR_MASS))
    value = F.lit(SOLAR_CONSTANT) * F.pow(col(transmission), air_mass) * sine
    return F.when(col(elevation_deg) <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), value))


def seasonal_factor(latitude, day_of_year, variation) -> Column:
    """Cosine around the local midsummer day, never below 0.2."""
    peak = F.when(col(latitude) >= 0, F.lit(172)).otherwise(F.lit(355))
    wave = F.cos(F.lit(2 * math.pi) * (col(day_of_year) - peak) / F.lit(365.0))
    return F.greatest(F.lit(0.2), F.lit(1.0) + col(variation) * wave)


def base_cloud_factor(day_of_year, cloud_factor) -> Column:
    wave = F.cos(F.lit(2 * math.pi) * (col(day_of_year) - F.lit(172)) / F.lit(365.0))
    return col(cloud_factor) * (F.lit(0.8) + F.lit(0.2) * wave)
