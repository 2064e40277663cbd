from __future__ import annotations

import json

import pytest
from hypothesis import given, settings, strategies as st

from heliofleet.sources import columns as C, files, payloads


@pytest.mark.parametrize("names, expected", [
    (["Date/Time", "Energy Produced (Wh)", "Energy Consumed (Wh)", "Exported to Grid (Wh)",
      "Imported from Grid (Wh)"],
     {"datetime": "Date/Time", "production": "Energy Produced (Wh)",
      "consumption": "Energy Consumed (Wh)", "export": "Exported to Grid (Wh)",
      "import": "Imported from Grid (Wh)"}),
    (["timestamp", "solar_generation", "usage", "grid_out", "grid_in"],
     {"datetime": "timestamp", "production": "solar_generation", "consumption": "usage",
      "export": "grid_out", "import": "grid_in"}),
    (["erzeugung", "verbrauch"], {"production": "erzeugung", "consumption": "verbrauch"}),
    (["producción", "consumo"], {"production": "producción", "consumption": "consumo"}),
    (["foo", "bar"], {}),
])
def test_roles_by_name(names, expected):
    assert C.detect(names) == expected


def test_ambiguous_names_prefer_a_unit_then_the_shortest():
    assert C.detect(["Production Day", "Production Night (kWh)", "Consumption"])["production"] \
        == "Production Night (kWh)"
    assert C.detect(["total production", "production"])["production"] == "production"
    with pytest.raises(C.AmbiguousColumns):
        C.detect(["production a", "production b"], strict=True)
    with pytest.raises(C.MissingColumns):
        C.detect(["consumption"], strict=True)


def test_confidence_levels():
    assert C.confidence("solar output", C.WORDS["production"]) == 1.0
    assert C.confidence("xsolarx", C.WORDS["production"]) == 0.9
    assert C.confidence("producton", C.WORDS["production"]) >= 0.8
    assert C.confidence("zzz", C.WORDS["production"]) == 0.0


def test_extra_words_and_suggestions():
    assert C.detect(["rooftop"], extra={"production": ["rooftop"]}) == {"production": "rooftop"}
    assert C.suggest(["production", "pv power", "load"])["production"] == ["production", "pv power"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=12), min_size=1, max_size=8, unique=True))
def test_detection_never_invents_columns(names):
    found = C.detect(names)
    assert set(found.values()) <= set(names) and set(found) <= set(C.ROLES)


def test_wide_headers_resolve_quickly():
    import time
    start = time.perf_counter()
    C.detect([f"column_{i}" for i in range(100)] + ["production", "consumption"])
    assert time.perf_counter() - start < 0.5


def test_feeds_of_different_shape_unite(spark):
    a = spark.createDataFrame([(1, "t", 1.0)], "site_id BIGINT, date STRING, `PV (kWh)` DOUBLE")
    b = spark.createDataFrame([(2, "t", 2.0, 3.0)],
                              "site_id BIGINT, time STRING, produced DOUBLE, used DOUBLE")
    rows = {r.site_id: r for r in C.union_feeds([a, b]).collect()}
    assert rows[1].production_kwh == 1.0 and rows[1].consumption_kwh is None
    assert rows[2].production_kwh == 2.0 and rows[2].consumption_kwh == 3.0


def test_validation_status(spark):
    df = spark.createDataFrame([(1.0, None)], "production DOUBLE, consumption DOUBLE")
    rows = {r.role: r for r in C.validate_feed(df).collect()}
    assert rows["production"].status == "WARNING"
    assert rows["production"].non_null == 1 and rows["consumption"].non_null == 0
    assert rows["export"].detected == 0 and rows["export"].column is None


def test_csv_reader_parses_both_layouts_and_units(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "Date/Time,Energy Produced (Wh),Energy Consumed (Wh)\n"
        "2023-01-01 00:00:00,0,800\n01/02/2023 00:15,1000,x\n")
    raw = files.read_interval_csv(spark, str(tmp_path / "a.csv"), site_id=7)
    assert raw.columns == ["site_id", "ts", "Energy Produced (Wh)", "Energy Consumed (Wh)"]
    kwh = C.harmonise(raw.drop("ts"))
    rows = raw.orderBy("ts").collect()
    assert str(rows[1].ts) == "2023-01-02 00:15:00" and rows[1][3] is None
    assert {c for c in kwh.columns} == {"site_id", "production_kwh", "consumption_kwh"}
    with pytest.raises(ValueError):
        files.read_interval_csv(spark, str(tmp_path / "a.csv"), ts_col="nope")


def test_only_watt_hours_are_converted(spark):
    df = spark.createDataFrame([(1, 1500.0, 2.0, 3.0)],
                               "site_id BIGINT, `Production (Wh)` DOUBLE, load_kwh DOUBLE, x DOUBLE")
    row = files.wh_to_kwh(df).first()
    assert row.production_kwh == 1.5 and row.load_kwh == 2.0 and row.x == 3.0


def doc(spark, payload):
    return spark.createDataFrame([(1, json.dumps(payload))], "site_id BIGINT, payload STRING")


def test_lifetime_payload(spark):
    raw = doc(spark, {"start_date": "2024-01-30", "production": [100, 0, -5, 300]})
    rows = payloads.parse_energy_lifetime(raw).orderBy("day").collect()
    assert [str(r.day) for r in rows] == ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02"]
    assert [r.daily_energy_kwh for r in rows] == [0.1, 0.0, 0.0, 0.3]
    assert payloads.parse_energy_lifetime(doc(spark, {"production": [1]})).count() == 0


def test_revenue_meter_payload_with_missing_values(spark):
    raw = doc(spark, {"meter_intervals": [{"meter_serial_number": "m", "intervals": [
        {"channel": 2, "end_at": 1704067200, "wh_del": None, "curr_w": 500},
        {"end_at": 1704068100, "wh_del": 250}]}]})
    rows = payloads.parse_rgm_stats(raw).orderBy("ts").collect()
    assert (rows[0].channel, rows[0].energy_delivered_kwh, rows[0].current_power_kw) == (2, 0.0, 0.5)
    assert (rows[1].channel, rows[1].energy_delivered_kwh, rows[1].current_power_w) == (1, 0.25, 0.0)
    assert rows[0].gateway_serial == "unknown" and str(rows[0].ts) == "2024-01-01 00:00:00"


def test_weather_payload_defaults(spark):
    raw = doc(spark, {"hourly": {"time": ["2024-01-01T00:00"], "temperature_2m": [None],
                                 "visibility": [0], "surface_pressure": [0],
                                 "shortwave_radiation": [None]}})
    row = payloads.parse_weather_hourly(raw).first()
    assert (row.temperature, row.visibility, row.pressure, row.ghi) == (0.0, 10.0, 1013.0, None)
    assert str(row.ts) == "2024-01-01 00:00:00"


def test_dataset_round_trip(spark, tmp_path, daily_of):
    df = daily_of([(1, "2023-12-31", 1.0), (1, "2024-01-01", 2.0)])
    path = files.write_dataset(df, str(tmp_path / "out"))
    back = spark.read.parquet(path).where("year = 2024")
    assert [r.production_kwh for r in back.collect()] == [2.0]
