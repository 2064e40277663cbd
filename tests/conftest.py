from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from heliofleet.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def daily_of(spark):
    """Rows (site, 'yyyy-mm-dd', production[, consumption, export, import]) as a daily frame."""
    def make(rows):
        full = [tuple(r) + (0.0,) * (6 - len(r)) for r in rows]
        return spark.createDataFrame(
            full, "site_id BIGINT, day STRING, production_kwh DOUBLE, consumption_kwh DOUBLE, "
                  "export_kwh DOUBLE, import_kwh DOUBLE").selectExpr(
            "site_id", "CAST(day AS DATE) AS day", "production_kwh", "consumption_kwh",
            "export_kwh", "import_kwh")
    return make


@pytest.fixture(scope="session")
def intervals_of(spark):
    """Rows (site, 'yyyy-mm-dd hh:mm', production, consumption, export, import)."""
    def make(rows):
        return spark.createDataFrame(
            rows, "site_id BIGINT, ts STRING, production_kwh DOUBLE, consumption_kwh DOUBLE, "
                  "export_kwh DOUBLE, import_kwh DOUBLE").selectExpr(
            "site_id", "CAST(ts AS TIMESTAMP) AS ts", "production_kwh", "consumption_kwh",
            "export_kwh", "import_kwh")
    return make
