from __future__ import annotations

import random

import numpy as np
import pytest

from heliofleet.operators import quality as Q, timeline
from heliofleet.operators.quantiles import site_quantiles


def rows_at(minutes, site=1):
    return [(site, f"2024-01-{1 + m // 1440:02d} {m % 1440 // 60:02d}:{m % 60:02d}", 1.0, 1.0, 0.0, 0.0) for m in minutes]


def test_gap_must_exceed_one_and_a_half_steps(intervals_of):
    # steps in minutes: 10, 10, 10, 15 (1.5 x), 16 (1.6 x)
    df = intervals_of(rows_at([0, 10, 20, 30, 45, 61]))
    gaps = timeline.time_gaps(df).collect()
    assert [g.gap_seconds for g in gaps] == [960] and gaps[0].expected_seconds == 600


def test_steps_cross_midnight_and_count_copies(intervals_of):
    df = intervals_of(rows_at([1425, 1440, 1440, 1455]))
    steps = sorted((r.step_seconds, r.n) for r in timeline.steps(df).groupBy("step_seconds").sum("n")
                   .withColumnRenamed("sum(n)", "n").collect())
    assert steps == [(0, 1), (900, 2)]
    dup = timeline.duplicate_timestamps(df).first()
    assert (dup.rows, dup.duplicates) == (4, 1)


def test_granularity_prefers_the_smaller_step_on_a_tie(intervals_of):
    df = intervals_of(rows_at([0, 15, 75]))
    row = timeline.granularity(df).first()
    assert row.granularity == "15min"


def test_temporal_completeness(intervals_of):
    df = intervals_of(rows_at([0, 15, 30, 90]))
    row = timeline.temporal_completeness(df).first()
    assert (row.expected_records, row.actual_records, row.missing_intervals) == (7, 4, 3)
    assert (row.gaps_detected, row.largest_gap_seconds) == (1, 3600)


def test_overview_of_a_single_row(intervals_of):
    row = timeline.dataset_overview(intervals_of(rows_at([0]))).first()
    assert row.granularity == "insufficient_data" and row.expected_records is None


@pytest.mark.parametrize("seed", range(4))
def test_distributed_quantiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, -3.5, rng.gauss(0, 100), rng.random(), 7.25, 1e-9, 1e9 * rng.random()])
              for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 5.0)], "site_id BIGINT, v DOUBLE")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    rows = {r.site_id: r for r in site_quantiles(df, ["v"], probs).collect()}
    for i, p in enumerate(probs):
        assert rows[1][f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
        assert rows[2][f"q{i}"] == 5.0
    assert rows[1].n == len(values)


def test_quality_of_a_feed_with_known_defects(intervals_of):
    rows = []
    for i in range(100):
        row = [1, f"2024-01-{1 + i // 96:02d} {i % 96 // 4:02d}:{i % 4 * 15:02d}", 1.0, 1.0, 0.0, 0.0]
        if 10 <= i < 15:
            row[2:] = [None] * 4
        if i == 20:
            row[2] = -0.1
        if i == 30:
            row[4] = 3.0
        rows.append(tuple(row))
    df = intervals_of(rows)
    rules = {r.rule: r.records for r in Q.integrity(df).collect()}
    assert rules["negative_production"] == 1 and rules["excess_export"] == 1 + 1  # 0 > -0.1 too
    assert rules["missing_values"] == 20 and rules["energy_balance"] == 2
    assert rules["outliers:production_kwh"] == 1 and rules["outliers:export_kwh"] == 1
    assert rules["outliers:consumption_kwh"] == 0
    score = Q.quality_score(df).first()
    # 5 % missing, two kinds of issue, balance + two outlying columns
    assert score.quality_score == pytest.approx(100 - 2.5 - 20 - 6)
    assert (score.issues, score.warnings, score.assessment) == (2, 3, "Fair")
    complete = {r.column: r for r in Q.completeness(df).collect()}
    assert complete["*"].completeness_pct == 95.0 and complete["production_kwh"].missing == 5
    odd = Q.iqr_outliers(df).collect()
    assert {(r.column, r.value) for r in odd} == {("production_kwh", -0.1), ("export_kwh", 3.0)}


def test_three_values_have_no_fences(intervals_of):
    assert Q.outlier_bounds(intervals_of(rows_at([0, 15, 30]))).count() == 0


def test_missing_actions(intervals_of):
    rows = [(1, f"2024-01-01 0{i}:00", None if i < 6 else 1.0, None if i < 2 else 1.0, 1.0, 1.0) for i in range(10)]
    found = {r.column: r for r in Q.missing_values(intervals_of(rows)).collect()}
    assert [found[c].action for c in ("production_kwh", "consumption_kwh", "export_kwh")] == ["drop", "investigate", "keep"]
    assert found["export_kwh"].worst_column == "production_kwh"


def test_hot_site_is_spread(spark, intervals_of):
    """A site with most rows gives the same fences as it does alone."""
    hot = [(1, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00", float(i % 37), 0.0, 0.0, 0.0) for i in range(600)]
    cold = rows_at([0, 15, 30, 45], site=2)
    both = Q.outlier_bounds(intervals_of(hot + cold), ["production_kwh"]).where("site_id = 1").first()
    want = np.quantile([r[2] for r in hot], [0.25, 0.75])
    assert (both.p25, both.p75) == (want[0], want[1])
