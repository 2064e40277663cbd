from __future__ import annotations

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from heliofleet.operators import metrics, rollup, selection, windows as W
from heliofleet.plans import features


def days(n, start=1):
    return [(1, f"2024-{1 + (i // 28):02d}-{1 + i % 28:02d}", float(start + i)) for i in range(n)]


def test_empty_days_sum_to_zero_and_have_no_mean(intervals_of):
    df = intervals_of([(1, "2024-01-01 10:00", 1.0, 2.0, None, 0.5), (1, "2024-01-01 10:15", 2.0, 1.0, None, 0.5),
                       (1, "2024-01-03 10:00", 4.0, 1.0, 1.0, 0.5), (2, "2024-02-01 00:00", 1.0, 1.0, 1.0, 1.0)])
    sums = {(r.site_id, str(r.day)): r for r in rollup.daily_summary(df).collect()}
    assert len(sums) == 4  # three days of site 1, one of site 2
    assert sums[1, "2024-01-01"].production_kwh == 3.0 and sums[1, "2024-01-01"].export_kwh == 0.0
    assert sums[1, "2024-01-02"].production_kwh == 0.0
    means = {(r.site_id, str(r.day)): r for r in rollup.daily_summary(df, "mean").collect()}
    assert means[1, "2024-01-02"].production_kwh is None and means[1, "2024-01-01"].production_kwh == 1.5
    with pytest.raises(ValueError):
        rollup.daily_summary(df, "median")


def test_constant_day(intervals_of):
    rows = [(1, f"2024-01-01 {i // 4:02d}:{i % 4 * 15:02d}", 0.5, 0.3, 0.2, 0.0) for i in range(96)]
    row = rollup.daily_summary(intervals_of(rows)).first()
    assert row.production_kwh == pytest.approx(48.0) and row.consumption_kwh == pytest.approx(28.8)


def test_months_are_labelled_by_their_last_day(daily_of):
    df = daily_of([(1, "2024-01-15", 1.0), (1, "2024-02-10", 2.0), (1, "2024-05-01", 3.0)])
    rows = {str(r.month_end): r.production_kwh for r in rollup.monthly_summary(df).collect()}
    assert rows == {"2024-01-31": 1.0, "2024-02-29": 2.0, "2024-03-31": 0.0, "2024-04-30": 0.0, "2024-05-31": 3.0}


def test_zero_denominators(daily_of):
    df = daily_of([(1, "2024-01-01", 5.0, 0.0), (1, "2024-01-02", 0.0, 0.0), (1, "2024-01-03", 8.0, 4.0, 2.0)])
    rows = {str(r.day): r for r in metrics.self_consumption(metrics.net_energy(df)).collect()}
    assert rows["2024-01-01"].self_sufficiency_pct == 100.0
    assert rows["2024-01-02"].self_sufficiency_pct is None
    assert rows["2024-01-02"].self_consumption_rate_pct == 0.0
    assert rows["2024-01-01"].grid_independence_pct == 0.0
    assert rows["2024-01-03"].self_consumption_rate_pct == 75.0
    assert rows["2024-01-03"].grid_independence_pct == 100.0  # 150 clipped


def test_rolling_starts_with_one_row(daily_of):
    rows = W.temporal_rolling(daily_of(days(10))).orderBy("day").collect()
    assert rows[0].rolling_mean_7d == 1.0 and rows[0].rolling_std_7d is None
    assert rows[9].rolling_mean_7d == 7.0 and rows[9].rolling_median_7d == 7.0
    assert rows[9].rolling_range_7d == 6.0
    assert rows[9].rolling_std_7d == pytest.approx(statistics.stdev(range(4, 11)))


def test_even_centred_window_reaches_further_back(daily_of):
    rows = W.rolling_centered(daily_of(days(40))).orderBy("day").collect()
    known = [i for i, r in enumerate(rows) if r.centered_mean_30d is not None]
    assert len(rows) - len(known) == 29 and known[0] == 15
    assert rows[15].centered_mean_30d == statistics.mean(range(1, 31))
    assert rows[3].centered_mean_7d == 4.0 and rows[2].centered_mean_7d is None


def test_lags_do_not_cross_sites(daily_of):
    df = daily_of(days(3) + [(2, "2024-01-01", 50.0)])
    rows = {(r.site_id, str(r.day)): r for r in W.lags(df).collect()}
    assert rows[2, "2024-01-01"].production_kwh_lag_1d is None
    assert rows[1, "2024-01-02"].change_from_1d_ago == 1.0
    assert rows[1, "2024-01-02"].pct_change_from_1d_ago == pytest.approx(1 / 1.01 * 100)


def test_strict_windows_wait_for_all_rows(daily_of):
    rows = W.rolling_strict(daily_of(days(8))).orderBy("day").collect()
    assert rows[5].prod_7day_avg is None and rows[6].prod_7day_avg == 4.0


def test_fill_missing(daily_of):
    df = daily_of(days(3)).select("site_id", "day", F.when(F.col("production_kwh") == 1, 5.0).alias("x_lag_1"),
                                  F.when(F.col("production_kwh") > 1, F.col("production_kwh")).alias("rolling_x"))
    rows = selection.fill_missing(df).orderBy("day").collect()
    assert [r.x_lag_1 for r in rows] == [5.0, 5.0, 5.0]
    assert [r.rolling_x for r in rows] == [2.5, 2.0, 3.0]


def test_leak_safe_rolling_ends_on_the_day_before(daily_of):
    rows = features.ml_dataset_basic(daily_of([r + (1.0,) for r in days(10)]), clean=False,
                                     leak_safe=True).orderBy("day").collect()
    assert rows[0].production_rolling_mean_7d is None and rows[9].production_rolling_mean_7d == 6.0
    assert "net_energy_kwh" not in rows[0].asDict()


def test_one_exchange_per_key(daily_of, intervals_of):
    df = intervals_of([(1, "2024-01-01 10:00", 1.0, 1.0, 0.0, 0.0)])
    wide = features.temporal_features(rollup.daily_summary(df))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2, exchanges
    assert sum("_groupingexpression" in e or "day" in e for e in exchanges) == 1


def test_top_rows_are_limited_before_the_shuffle(daily_of):
    plan = selection.tail(daily_of(days(3)), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_missing_months_do_not_break_the_year(daily_of):
    from heliofleet.operators import profiles
    rows = profiles.monthly_savings(daily_of([(1, "2024-03-01", 10.0)]), 0.5).collect()
    assert len(rows) == 12 and sum(r.savings for r in rows) == 5.0
    assert math.isclose(next(r.savings for r in rows if r.month == 3), 5.0)


def test_rolling_figures_without_sliding_frames(spark):
    nan, far = float("nan"), 1e9
    values = [None, 5.0, nan, None, 3.0, 3.0, far, far + 0.5, far + 1, None, None, None, -2.0, 0.1, 0.1, 0.1]
    rows = [(site, "a", i, v, None if v is None or v != v else int(v) + (1 << 60)) for site in (1, 2, None)
            for i, v in enumerate(values) if site != 2 or i < 5]
    df = spark.createDataFrame(rows, "site_id BIGINT, tag STRING, i INT, production_kwh DOUBLE, whole BIGINT").selectExpr(
        "site_id", "tag", "CASE WHEN i > 0 THEN date_add(DATE'2024-01-01', i) END AS day", "production_kwh", "whole")
    cols, windows, stats = ("production_kwh", "whole"), (1, 3, 7), ("mean", "std", "min", "max")
    found = W.rolling_stats(df, cols, windows, stats)
    assert "specifiedwindowframe" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    plain = df.withColumns({f"{c.removesuffix('_kwh')}_rolling_{s}_{n}d": W.ROLLING[s](c).over(W.trailing(n))
                            for c in cols for n in windows for s in stats})
    assert found.dtypes == plain.dtypes

    def told(rows):
        return {(r.site_id, r.day): r.asDict() for r in rows.collect()}
    a, b = told(found), told(plain)
    assert a.keys() == b.keys()
    for key, row in b.items():
        for name, value in row.items():
            if name.startswith("whole_rolling_std"):
                continue  # the readings differ by less than doubles of their size can tell
            if isinstance(value, float):
                assert a[key][name] == pytest.approx(value, rel=1e-9, abs=1e-9, nan_ok=True), (key, name)
            else:
                assert a[key][name] == value, (key, name)
    assert W.rolling_stats(df.where("site_id > 9"), cols).count() == 0
