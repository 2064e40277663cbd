from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from heliofleet.functions import solar
from heliofleet.operators import finance as Fi, location, tariffs
from heliofleet.plans import features
from heliofleet.sources import dims

SITES = "site_id BIGINT, latitude DOUBLE, longitude DOUBLE"


@pytest.fixture(scope="module")
def denver(spark):
    return spark.createDataFrame([(1, 39.7392, -104.9903, "Denver", "x")],
                                 SITES + ", location_name STRING, timezone STRING")


def test_declination_and_daylight_bounds(denver):
    cal = {str(r.day): r for r in location.geometry_calendar(denver, 2024).collect()}
    assert len(cal) == 366
    assert cal["2024-06-21"].declination == pytest.approx(23.45, abs=1)
    assert cal["2024-12-21"].declination == pytest.approx(-23.45, abs=1)
    assert 14 <= cal["2024-06-21"].daylight_hours <= 16 and 8 <= cal["2024-12-21"].daylight_hours <= 10
    assert 70 <= cal["2024-06-21"].noon_elevation <= 90
    extremes = location.geometry_extremes(location.geometry_calendar(denver, 2024)).first()
    assert extremes.longest_day.month == 6 and extremes.shortest_day.month == 12


def test_polar_day_and_night(spark):
    df = spark.createDataFrame([(80.0, 172), (80.0, 355), (0.0, 80)], "lat DOUBLE, doy INT")
    hours = [r.h for r in df.select(solar.daylight_hours("lat", "doy").alias("h")).collect()]
    assert hours[0] == pytest.approx(24) and hours[1] == pytest.approx(0) and hours[2] == pytest.approx(12)


def test_night_has_no_irradiance(spark):
    df = spark.createDataFrame([(0.0,), (90.0,), (1.0,)], "el DOUBLE")
    values = [r.i for r in df.select(solar.irradiance("el", F.lit(0.7)).alias("i")).collect()]
    assert values[0] == 0.0 and values[1] == pytest.approx(1361 * 0.7)
    assert values[2] == pytest.approx(1361 * 0.7 ** 10 * math.sin(math.radians(1)))


def test_climate_classes(spark):
    df = spark.createDataFrame([(i, lat, 0.0) for i, lat in enumerate((10.0, -30.0, 40.0, 60.0, 80.0))], SITES)
    rows = location.site_climate(df).orderBy("site_id").collect()
    assert [r.climate_type for r in rows] == list(solar.CLIMATE_NAMES)
    assert [r.climate_type_encoded for r in rows] == [0.7, 0.8, 0.7, 0.7, 0.7]
    assert [r.cloud_factor for r in rows] == [0.7, 0.8, 0.75, 0.6, 0.6]


def test_seasons_turn_around_in_the_south(spark):
    df = spark.createDataFrame([(1, 40.0, 0.0), (2, -40.0, 0.0)], SITES)
    rows = {(r.site_id, str(r.day)): r.seasonal_factor for r in location.geometry_calendar(df, 2024).collect()}
    assert rows[1, "2024-06-20"] > rows[1, "2024-12-20"] and rows[2, "2024-06-20"] < rows[2, "2024-12-20"]
    assert min(rows.values()) >= 0.2


def test_coordinates_are_checked(spark):
    bad = spark.createDataFrame([(1, 91.0, 0.0)], SITES)
    with pytest.raises(Exception, match="out of range"):
        location.checked_sites(bad).collect()


@pytest.mark.parametrize("lat, lon, state", [
    (39.7392, -104.9903, "CO"), (37.7749, -122.4194, "CA"), (0.0, 0.0, None),
    (35.7, -122.4194, "CA"), (40.7128, -79.0060 + 5.0, "NY")])
def test_nearest_state(spark, lat, lon, state):
    row = tariffs.nearest_tariff(spark.createDataFrame([(1, lat, lon)], SITES)).first()
    assert row.state == state
    if state is None:
        assert (row.residential_rate, row.source, row.confidence) == (16.22, "national_average", "low")


def test_anchor_radius_is_strict(spark):
    lat, lon, _ = dims.RATE_ANCHORS[17]  # Miami has no other anchor near
    rows = spark.createDataFrame([(1, lat - 5.0, lon), (2, lat - 4.999, lon)], SITES)
    found = {r.site_id: r.state for r in tariffs.nearest_tariff(rows).collect()}
    assert found == {1: None, 2: "FL"}


def test_rates_by_name_and_abbreviation(spark):
    df = spark.createDataFrame([(1, "New York"), (2, "ca"), (3, "nowhere")], "site_id BIGINT, state STRING")
    rows = {r.site_id: (r.state_code, r.residential_rate) for r in tariffs.tariff_by_state(df).collect()}
    assert rows == {1: ("NY", 25.30), 2: ("CA", 30.62), 3: (None, 16.22)}
    assert len(dims.STATE_RATES) == 50 and len({r[1] for r in dims.STATE_RATES}) == 50


@pytest.fixture(scope="module")
def year(daily_of):
    first = date(2024, 1, 1)
    return daily_of([(1, str(first + timedelta(i)), 25.0, 30.0, 10.0, 15.0) for i in range(365)])


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([(1, 0.12, 0.08, 12.0, 8.0)],
                                 "site_id BIGINT, annual_cost_per_kwh DOUBLE, feed_in_rate_per_kwh DOUBLE,"
                                 " residential_rate DOUBLE, feed_in_tariff DOUBLE")


@pytest.fixture(scope="module")
def costs(spark):
    return spark.createDataFrame([(1, None)], "site_id BIGINT, system_size_kw DOUBLE")


def test_annual_figures_of_a_constant_year(year):
    row = Fi.annual_metrics(year).first()
    assert row.annual_production_kwh == pytest.approx(9131.25)
    assert row.annual_consumption_kwh == pytest.approx(10957.5)
    assert row.annual_export_kwh == pytest.approx(3652.5) and row.annual_import_kwh == pytest.approx(5478.75)
    assert row.daily_average_kwh == 25.0 and row.self_consumption_rate == pytest.approx(60.0)


def test_default_costs(costs):
    row = Fi.net_system_cost(costs).first()
    assert (row.total_cost, row.federal_tax_credit, row.net_system_cost) == (25000.0, 7500.0, 17500.0)


def test_analysis_of_a_constant_year(year, rates, costs):
    row = Fi.financial_analysis(year, rates, costs).first()
    scale = 365.25 / 365
    assert row.annual_export_income == pytest.approx(292.0 * scale)
    assert row.annual_import_savings == pytest.approx(657.0 * scale)
    assert row.total_annual_savings == pytest.approx(949.0 * scale)
    assert row.without_solar_cost == pytest.approx(1314.0 * scale)
    lifetime = sum(949.0 * scale * 0.995 ** k for k in range(25))
    assert row.lifetime_savings == pytest.approx(lifetime)
    assert row.simple_payback_years == pytest.approx(17500 / (949.0 * scale))
    assert row.roi_percentage == pytest.approx((lifetime - 17500) / 17500 * 100)
    assert row.capacity_factor == pytest.approx(9131.25 / 87600 * 100)


def test_no_savings_mean_no_payback(spark):
    df = spark.createDataFrame([(1, 0.0, 1000.0)], "site_id BIGINT, total_annual_savings DOUBLE, net_system_cost DOUBLE")
    row = Fi.roi_metrics(df).first()
    assert row.simple_payback_years is None and row.roi_percentage == -100.0


def test_missing_rate_columns_raise(year, spark, costs):
    with pytest.raises(ValueError, match="annual_cost_per_kwh"):
        Fi.financial_analysis(year, spark.createDataFrame([(1,)], "site_id BIGINT"), costs)


def test_sites_without_tariff_and_finance_rows_stay(year, rates, costs):
    """They take the national rate and the default costs."""
    none_of = rates.where("site_id = 2"), costs.where("site_id = 2")
    row = Fi.financial_analysis(year, *none_of).first()
    scale = 365.25 / 365
    assert row.annual_cost_per_kwh == pytest.approx(0.1622) and row.net_system_cost == 17500.0
    assert row.annual_import_savings == pytest.approx(15.0 * 365 * 0.1622 * scale)
    assert Fi.period_benefit(year, none_of[0]).first().import_cost == pytest.approx(15.0 * 365 * 0.1622)
    assert Fi.daily_net_cost(year, none_of[0]).where("daily_net_cost IS NOT NULL").count() == 365


def test_projection_finds_the_first_positive_year(spark):
    df = spark.createDataFrame([(1, 1000.0, 400.0), (2, 100000.0, 1.0)], "site_id BIGINT, system_cost DOUBLE, annual_savings DOUBLE")
    rows = {(r.site_id, r.year): r for r in Fi.roi_projection(df).collect()}
    assert rows[1, 1].payback_year == 3 and rows[2, 25].payback_year is None and len(rows) == 50


def test_feature_set_has_every_column_and_one_row_per_day(year, rates, costs, denver, spark):
    wx = spark.createDataFrame([(1, date(2024, 1, 1) + timedelta(i), float(i % 13), float(i % 101), 20.0, 25.0, 15.0, 0.0, 5.0)
                                for i in range(365)],
                               "site_id BIGINT, day DATE, sunshine_hours DOUBLE, cloudcover_mean_pct DOUBLE, temp_mean_c DOUBLE,"
                               " temp_max_c DOUBLE, temp_min_c DOUBLE, precipitation_mm DOUBLE, solar_radiation_mj DOUBLE")
    sites = denver.select("site_id", "latitude", "longitude")
    df = features.feature_set(year, features.FEATURE_SETS, sites, rates, costs, wx, clean="none")
    rows = df.count()
    added = set(df.columns) - set(year.columns)
    assert rows == 365 and len(added) >= 90
    for name in ("rolling_median_14d", "production_kwh_lag_14d", "trend_30d", "daylight_hours_normalized", "financial_health_score",
                 "savings_trend_14d", "weather_quality_index", "temp_mean_c_volatility_7d"):
        assert name in added
    assert features.feature_set(year, ("temporal",), clean="fillna").where("trend_30d IS NULL").count() == 0
    with pytest.raises(ValueError):
        features.feature_set(year, ("location",))
    by = features.features_by_category(year, sites, rates, costs, wx)
    assert set(by) == {"temporal", "location", "financial", "weather"} and "production_kwh" not in by["weather"].columns
