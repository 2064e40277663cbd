from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from heliofleet.plans import anomalies as An, models as M
from heliofleet.schema import INTERVAL_SCHEMA
from heliofleet.session import work_path
from heliofleet.streaming import live


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(5)
    rows = [(s, date(2024, 1, 1) + timedelta(i), 20 + rng.gauss(0, 1), rng.gauss(0, 1)) for s in (1, 2) for i in range(300)]
    for s in (1, 2):
        rows.append((s, date(2025, 1, 1), 90.0, 9.0))
    return spark.createDataFrame(rows, "site_id BIGINT, day DATE, production_kwh DOUBLE, x DOUBLE").persist()


def test_splits(noisy):
    last = M.temporal_split(noisy, 50).where("is_test = 1")
    assert {r["count"] for r in last.groupBy("site_id").count().collect()} == {50}
    share = M.share_split(noisy, 0.2).where("is_test = 1").groupBy("site_id").agg(F.count("*").alias("n"), F.min("day").alias("d"))
    assert {r.n for r in share.collect()} == {61}  # ceil(0.2 * 301)
    oldest = M.share_split(noisy, 0.2).where("is_test = 0").agg(F.max("day")).first()[0]
    assert oldest < share.first().d


def test_metrics_of_known_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0), (None, 1.0)], "production_kwh DOUBLE, prediction DOUBLE")
    row = M.regression_metrics(df).first()
    assert (row.n, row.mae, row.mse) == (3, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert row.r2 == pytest.approx(1 - 2 / 8)


def test_compare_models_picks_the_lowest_error(spark):
    rows = [(1, date(2024, 1, 1) + timedelta(i), float(i), 2.0 * i + 1) for i in range(120)]
    df = M.share_split(spark.createDataFrame(rows, "site_id BIGINT, day DATE, x DOUBLE, production_kwh DOUBLE"))
    scores, fitted = M.compare_models(df, ["x"], trees=5, rounds=5)
    best = scores.where("is_best = 1").collect()
    assert [b.model for b in best] == ["Linear Regression"] and best[0].rmse == pytest.approx(0, abs=1e-6)
    table = M.feature_importance(fitted["Random Forest"], ["x"], spark).collect()
    assert table[0].feature == "x" and table[0].importance == pytest.approx(1.0)


def test_trees_grow_on_few_partitions(spark, monkeypatch):
    seen = []

    class Watched:
        def __init__(self, pipeline):
            self.pipeline, self.getStages = pipeline, pipeline.getStages

        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count(), set(rows.columns)))
            return self.pipeline.fit(rows)

    df = spark.range(4000).selectExpr("id", "id % 7 AS more", "CAST(id % 50 AS DOUBLE) AS x",
                                      "CASE WHEN id % 4 > 0 THEN id % 50 * 2D END AS production_kwh")
    parts = df.repartition(64, "id")
    M.fit(Watched(M.boosted(["x"], rounds=2)), parts)
    monkeypatch.setattr(M, "ROWS_PER_TASK", 10)
    M.fit(Watched(M.boosted(["x"], rounds=2)), parts)
    most = 2 * spark.sparkContext.defaultParallelism
    assert seen == [(1, 3000, {"x", "production_kwh"}), (most, 3000, {"x", "production_kwh"})]
    with pytest.raises(Exception):  # nothing to learn from
        M.fit(M.boosted(["x"], rounds=2), parts.where("id < 0"))


def test_models_are_compared_on_rows_computed_once(noisy, monkeypatch):
    computed = []
    monkeypatch.setattr(M, "stored", lambda df, name, old=M.stored: computed.append(name) or old(df, name))
    scores, _ = M.compare_models(M.share_split(noisy), ["x"], trees=2, rounds=2)
    assert {(r.model, r.n) for r in scores.collect()} == {(m, 122) for m in ("Linear Regression", "Random Forest", "Gradient Boosting")}
    _, scored = M.train_forecaster(noisy, ["x"], rounds=2, last_n=10)
    assert scored.count() == 20 and len(computed) == 2


def test_forest_finds_planted_anomalies(noisy):
    scored = An.anomalies(noisy, ["production_kwh", "x"], 0.05, trees=40).persist()
    worst = {(r.site_id, r.production_kwh) for r in An.most_anomalous(scored, 1).collect()}
    assert worst == {(1, 90.0), (2, 90.0)}
    for r in An.anomaly_summary(scored).collect():
        assert 3 <= r.anomaly_rate_pct <= 6
    again = An.anomalies(noisy.repartition(7), ["production_kwh", "x"], 0.05, trees=40)
    key = ("site_id", "day")
    a = {tuple(r[k] for k in key): r.anomaly_score for r in scored.collect()}
    b = {tuple(r[k] for k in key): r.anomaly_score for r in again.collect()}
    assert a == b  # independent of the partitioning


def test_tree_samples_are_bounded(noisy):
    drawn = An.sample_for_trees(noisy, 10, noisy.count(), sample=64).groupBy("tree").count().collect()
    assert len(drawn) == 10 and max(r["count"] for r in drawn) <= 64


def test_robust_rule_flags_the_outlier(daily_of):
    rows = [(1, str(date(2024, 1, 1) + timedelta(i)), 20.0 + i % 3) for i in range(60)] + [(1, "2024-03-01", 200.0)]
    flagged = An.robust_anomalies(daily_of(rows)).where("is_anomaly = 1").collect()
    assert "2024-03-01" in {str(r.day) for r in flagged}


def write_batches(spark, root, batches):
    """One file per batch. File streams read by modification time, so the files are a minute apart."""
    import json
    import os
    from pathlib import Path
    Path(root).mkdir(parents=True)
    for i, rows in enumerate(batches):
        lines = [json.dumps(dict(zip(("site_id", "ts", "production_kwh", "consumption_kwh", "export_kwh", "import_kwh"), r))) for r in rows]
        file = Path(root) / f"{i}.json"
        file.write_text("\n".join(lines))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)


def test_stream_rollup_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [(1, f"2024-01-0{d} {h:02d}:00:00", float(h), 1.0, 0.5, 0.0) for d in (1, 2, 3) for h in range(0, 24, 6)]
    write_batches(spark, tmp_path / "in", [rows[:5], rows[5:]])
    stream = live.read_stream(spark, str(tmp_path / "in"), INTERVAL_SCHEMA, "json", 1)
    out = live.materialise(live.streaming_rollup(stream, "1 day"), "t")
    got = {str(r.window_start)[:10]: (r.production_kwh, r.readings) for r in out.collect()}
    assert got == {"2024-01-01": (36.0, 4), "2024-01-02": (36.0, 4)}  # the third day is open


def test_resends_are_dropped_across_batches(spark, tmp_path):
    row = (1, "2024-01-01 10:00:00", 1.0, 1.0, 0.0, 0.0)
    other = (1, "2024-01-01 10:15:00", 1.0, 1.0, 0.0, 0.0)
    write_batches(spark, tmp_path / "in", [[row, row], [row, other]])
    stream = live.read_stream(spark, str(tmp_path / "in"), INTERVAL_SCHEMA, "json", 1)
    assert live.materialise(live.deduplicate(stream), "d").count() == 2


@pytest.mark.parametrize("prefer, value", [("sum", 12.0), ("current", 5.0), ("fresh", 7.0)])
def test_daily_table_over_two_batches(spark, tmp_path, prefer, value):
    write_batches(spark, tmp_path / "in", [[(1, "2024-01-01 10:00:00", 5.0, 0.0, 0.0, 0.0)],
                                           [(1, "2024-01-01 11:00:00", 7.0, 0.0, 0.0, 0.0), (1, "2024-01-02 10:00:00", 1.0, 0.0, 0.0, 0.0)]])
    stream = live.read_stream(spark, str(tmp_path / "in"), INTERVAL_SCHEMA, "json", 1)
    table = live.DailyTable(spark, work_path(spark, "table"), prefer)
    rows = {str(r.day): r.production_kwh for r in table.run(stream).collect()}
    assert rows == {"2024-01-01": value, "2024-01-02": 1.0}
    batch = spark.createDataFrame([(1, "2024-01-02 10:00:00", 1.0)], "site_id BIGINT, ts STRING, production_kwh DOUBLE").withColumn("ts", F.col("ts").cast("timestamp"))
    table.merge(batch, 2)
    before = sorted(map(tuple, table.read().collect()))
    table.merge(batch, 2)  # a replay of the batch changes nothing
    assert sorted(map(tuple, table.read().collect())) == before


def test_alert_rules(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [[(1, "2024-01-01 10:00:00", -1.0, 0.0, 0.0, 0.0), (1, "2024-01-01 10:15:00", 1.0, 0.0, 2.0, 0.0), (1, "2024-01-01 10:30:00", 1.0, 0.0, 0.0, 0.0)]])
    stream = live.read_stream(spark, str(tmp_path / "in"), INTERVAL_SCHEMA, "json")
    got = sorted(r.alert for r in live.materialise(live.rule_alerts(stream), "a").collect())
    assert got == ["excess_export", "excess_export", "negative_production"]


def test_entry_and_catalog(spark, sf_dir):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "rolling_median_7d" in df.columns
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) >= 150
    for name in ("c5_source_overlap", "e26_granularity"):
        kinds = {f.dataType for f in names[name](spark, sf_dir).schema.fields}
        assert kinds <= {T.LongType(), T.DoubleType(), T.StringType()}
