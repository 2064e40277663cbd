from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heliofleet.functions.numeric import correlation_strength
from heliofleet.operators import distribution, merging, metrics, weather as Wx
from heliofleet.sources import adapters


def test_correlation_bands(spark):
    df = spark.createDataFrame([(r,) for r in (0.9, 0.7, 0.5, 0.3, 0.1, -0.8)], "r DOUBLE")
    assert [x.s for x in df.select(correlation_strength("r").alias("s")).collect()] == [
        "Very Strong", "Strong", "Moderate", "Weak", "Very Weak", "Very Strong"]


def merged(spark, covers):
    return spark.createDataFrame([(1, float(c), 10.0, 50.0, 20.0) for c in covers],
                                 "site_id BIGINT, cloud_cover DOUBLE, production_kwh DOUBLE, humidity DOUBLE, temperature DOUBLE")


def test_cloud_bins_are_right_closed(spark):
    df = merged(spark, [0, 20, 20.1, 100])
    bins = {r.bin: r["count"] for r in Wx.by_cloud_bin(df).collect()}
    assert bins == {"Clear (0-20%)": 1, "Partly Cloudy (20-40%)": 1, "Overcast (80-100%)": 1}
    assert {r.bin: r["count"] for r in Wx.by_cloud_bin(df, include_lowest=True).collect()}["Clear (0-20%)"] == 2


def test_clear_sky_advantage_without_overcast(spark):
    assert Wx.clear_sky_advantage(merged(spark, [0, 10])).first().clear_sky_advantage == 1.0


def test_conditions_use_defaults(spark):
    df = spark.createDataFrame([(1, 5.0)], "site_id BIGINT, production_kwh DOUBLE")
    assert Wx.by_weather_condition(df).first().condition == "Mild & Cloudy"


def test_weather_factors_stay_in_range(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 100.0, 0.0, 20.0, 0.0, 0.0), (1, 5.0, 0.0, 100.0, 60.0, 100.0, 30.0), (1, 0.0, 0.0, 50.0, 25.0, 50.0, 5.0),
         (2, 5.0, None, 0.0, -100.0, 0.0, 0.0)],
        "site_id BIGINT, production_kwh DOUBLE, ghi DOUBLE, cloud_cover DOUBLE, temperature DOUBLE, humidity DOUBLE, wind_speed DOUBLE")
    rows = Wx.weather_factors(df).collect()
    first, capped, unknown, model = rows[0], rows[1], rows[2], rows[3]
    assert first.efficiency_factor == pytest.approx(10 / 15) and first.wind_factor == 1.0
    assert capped.efficiency_factor == 2.0 and capped.wind_factor == 1.2 and capped.cloud_factor == pytest.approx(0.2)
    assert unknown.efficiency_factor is None and model.efficiency_factor == 0.5


def test_score_and_missing_weather(spark):
    df = spark.createDataFrame([(1, 12.0, 0.0, 25.0, 0.0), (1, 0.0, 100.0, 25.0, 5.0), (1, None, 0.0, 25.0, 0.0)],
                               "site_id BIGINT, sunshine_hours DOUBLE, cloudcover_mean_pct DOUBLE, temp_mean_c DOUBLE, precipitation_mm DOUBLE")
    assert [r.solar_weather_score for r in Wx.solar_weather_score(df).collect()] == [100.0, 10.0, None]


@pytest.fixture(scope="module")
def feeds(daily_of):
    csv = daily_of([(1, "2024-01-01", 1.0, 1.0, 1.0, 1.0), (1, "2024-01-02", 2.0, 2.0, 2.0, 2.0)])
    api = daily_of([(1, "2024-01-02", 20.0), (1, "2024-01-03", 30.0)]).select("site_id", "day", "production_kwh")
    return csv, api


def as_dict(df):
    return {str(r.day): (r.production_kwh, r.consumption_kwh) for r in df.collect()}


def test_priorities(feeds):
    csv, api = feeds
    assert as_dict(merging.merge_sources(csv, api)) == {
        "2024-01-01": (1.0, 1.0), "2024-01-02": (2.0, 2.0), "2024-01-03": (30.0, None)}
    assert as_dict(merging.merge_sources(csv, api, "api_first")) == {
        "2024-01-01": (1.0, None), "2024-01-02": (20.0, None), "2024-01-03": (30.0, None)}
    assert set(as_dict(merging.merge_sources(csv, api, "csv_only"))) == {"2024-01-01", "2024-01-02"}
    with pytest.raises(ValueError):
        merging.merge_sources(csv, api, "best")


def test_overlap_and_update(feeds):
    csv, api = feeds
    o = merging.source_overlap(csv, api).first()
    assert (o.both, o.csv_only, o.api_only) == (1, 1, 1)
    updated, stats = merging.incremental_update(csv, api)
    s = stats.first()
    assert (s.existing_records, s.api_records, s.new_records, s.updated_records) == (2, 2, 1, 1)
    assert as_dict(updated)["2024-01-02"] == (2.0, 2.0)
    assert as_dict(merging.incremental_update(csv, api, "fresh")[0])["2024-01-02"] == (20.0, 2.0)


def test_recent_days_are_complete(feeds):
    rows = {str(r.day): (r.production_kwh, r.has_data) for r in merging.recent_daily(feeds[1], "2024-01-04", 3).collect()}
    assert rows == {"2024-01-01": (0.0, False), "2024-01-02": (20.0, True), "2024-01-03": (30.0, True)}


def test_hourly_merge_averages_both_sides(spark, intervals_of):
    prod = intervals_of([(1, "2024-01-01 10:00", 1.0, 1.0, 0.0, 0.0), (1, "2024-01-01 10:15", 3.0, 1.0, 0.0, 0.0),
                         (1, "2024-01-01 12:00", 9.0, 1.0, 0.0, 0.0)])
    wx = spark.createDataFrame([(1, "2024-01-01 10:30", 5.0), (1, "2024-01-01 11:00", 6.0)], "site_id BIGINT, ts STRING, temperature DOUBLE") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    row = merging.merge_weather_hourly(prod, wx).collect()
    assert len(row) == 1 and row[0].production_kwh == 2.0 and row[0].temperature == 5.0


def test_date_filter_reaches_the_scan(spark, tmp_path, daily_of):
    daily_of([(1, "2024-01-01", 1.0), (1, "2024-02-01", 2.0)]).write.parquet(str(tmp_path / "d"))
    df = merging.date_range_filter(spark.read.parquet(str(tmp_path / "d")), "2024-01-01", "2024-01-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and df.count() == 1


def test_date_filter_passes_the_adapter_and_columns_are_pruned(spark, sf_dir):
    df = merging.date_range_filter(adapters.daily_raw(spark, sf_dir), "1996-03-01", "1996-03-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan" in pushed
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert schema.count(":") == 5


@pytest.mark.parametrize("latest, band", [("2024-05-29", "very recent"), ("2024-05-17", "recent"), ("2024-04-17", "somewhat old"), ("2024-02-02", "old")])
def test_freshness_bands(daily_of, latest, band):
    assert metrics.freshness(daily_of([(1, latest, 1.0)]), "2024-06-01").first().recency == band


def test_histogram_edges(daily_of):
    rows = distribution.histogram(daily_of([(1, f"2024-01-{d:02d}", float(v)) for d, v in enumerate([0, 1, 5, 10, 10], 1)]), bins=10)
    counts = {r.bin: r["count"] for r in rows.collect()}
    assert len(counts) == 10 and counts[0] == 1 and counts[1] == 1 and counts[5] == 1 and counts[9] == 2
    flat = distribution.histogram(daily_of([(1, "2024-01-01", 3.0)]), bins=4).collect()
    assert sum(r["count"] for r in flat) == 1 and flat[0].bin_start == 2.5
