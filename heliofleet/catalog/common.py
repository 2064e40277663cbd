"""Frames that many queries start from."""

from __future__ import annotations

from ..operators.rollup import fill_days
from ..operators.tariffs import site_tariffs
from ..sources import adapters as A
from ..operators.merging import merge_weather_hourly


def daily(spark, sf_dir):
    return fill_days(A.daily_raw(spark, sf_dir))


def merged(spark, sf_dir):
    return merge_weather_hourly(A.intervals(spark, sf_dir), A.weather_hourly(spark, sf_dir))


def tariffs(spark, sf_dir):
    return site_tariffs(A.sites(spark, sf_dir))
