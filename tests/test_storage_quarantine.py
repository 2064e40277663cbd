"""Clustered storage, quarantine, anchors from a table, sketches and the one-pass timeline."""

from __future__ import annotations

import math
import os
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from heliofleet import schema as S
from heliofleet.operators import sketches, tariffs, timeline
from heliofleet.sources import clustered, quarantine
from heliofleet.session import work_path


def days_of(spark, rows):
    return spark.createDataFrame([(s, date(2022, 1, 1) + timedelta(d), v) for s, d, v in rows], "site_id BIGINT, day DATE, production_kwh DOUBLE")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_of(path):
    return {os.path.join(a, f): os.path.getmtime(os.path.join(a, f)) for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_clustered_table_needs_no_exchange_and_replaces_years(spark):
    path = work_path(spark, "clustered")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = [(s, d, float(d)) for s in range(20) for d in range(0, 1000, 3)]
    clustered.write_clustered(days_of(spark, rows), table, path, 4)
    stored = clustered.read_clustered(spark, table)
    per_site = stored.withColumn("before", F.lag("production_kwh").over(Window.partitionBy("site_id").orderBy("day")))
    summed = stored.groupBy("site_id").agg(F.sum("production_kwh").alias("v"))
    joined = stored.join(summed.withColumnRenamed("v", "total").hint("merge"), "site_id")
    for df in (per_site, summed, joined):
        df.collect()
        assert "Exchange" not in plan_of(df).replace("BroadcastExchange", "Exchange")
    before = files_of(path)
    clustered.write_clustered(days_of(spark, [(s, 800, -1.0) for s in range(20)]), table, path, 4)  # 2024
    after = files_of(path)
    kept = {f: t for f, t in before.items() if "year=2024" not in f}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert not any(f in after for f in before if "year=2024" in f)
    spark.catalog.refreshTable(table)
    got = {(r.site_id, (r.day - date(2022, 1, 1)).days): r.production_kwh for r in clustered.read_clustered(spark, table).collect()}
    assert got == {(s, d): v for s, d, v in rows if d < 730} | {(s, 800): -1.0 for s in range(20)}
    assert "PartitionFilters: [isnotnull(year" in plan_of(clustered.read_clustered(spark, table).where("year = 2023"))


def test_bad_lines_are_listed_with_file_and_reason(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("site_id,Date/Time,prod (Wh),cons (Wh)\n1,2024-01-01 10:00:00,5,6\n1,2024-01-01 10:15:00,x,7\n"
                                  "1,2024-01-01 10:30:00,5\n\"1\",\"2024-01-01 10:45:00\",,\"8\"\n")
    (folder / "b.csv").write_text("site_id,Date/Time,prod (Wh),cons (Wh)\n2,01/31/2024 10:00,1,NaN\n,2024-13-01 10:00:00,1,y\n3,2024-01-01 10:00:00,1,2,3\n")
    rows = quarantine.read_csv_checked(spark, str(folder), ["site_id", "Date/Time", "prod (Wh)", "cons (Wh)"])
    assert rows.count() == 7  # nothing is dropped
    fine = {(r.site_id, str(r.ts), r["prod (Wh)"], r["cons (Wh)"]) for r in quarantine.good(rows).collect()}
    assert fine == {(1, "2024-01-01 10:00:00", 5.0, 6.0), (1, "2024-01-01 10:45:00", None, 8.0), (2, "2024-01-31 10:00:00", 1.0, None)}
    told = Counter((r.file, r.problem) for r in quarantine.bad(rows).collect())
    assert told == Counter({("a.csv", "number:prod (Wh)"): 1, ("a.csv", "fields"): 1, ("b.csv", "fields"): 1,
                            ("b.csv", "time"): 1, ("b.csv", "site"): 1, ("b.csv", "number:cons (Wh)"): 1})
    assert {r.line for r in quarantine.bad(rows).where("problem = 'fields'").collect()} == {"1,2024-01-01 10:30:00,5", "3,2024-01-01 10:00:00,1,2,3"}


@pytest.mark.parametrize("text, problems", [
    ('{"intervals": [{"end_at": 5, "wh_del": 1.0}]}', []), ('{"intervals": [', ["json"]), ("{}", ["missing:intervals"]),
    (None, ["json"]), ("", ["json"]), ('{"intervals": "no"}', ["json"])])
def test_payloads_are_checked(spark, text, problems):
    raw = spark.createDataFrame([(1, text)], "site_id BIGINT, payload STRING")
    assert quarantine.check_payloads(raw, S.TELEMETRY_PAYLOAD, ["intervals"]).first().problems == problems


def test_nearest_anchor_equals_all_pairs(spark):
    rnd = random.Random(2)
    spot = lambda: (rnd.randint(-80, 80) / 4, rnd.randint(-160, 160) / 4)
    sites = [(i, *spot()) for i in range(200)] + [(900, None, 1.0), (901, 85.0, 85.0)]
    anchors = [(j, *spot()) for j in range(60)] + [(60, 0.0, 0.0), (61, 0.0, 0.0), (62, None, 0.0)]
    sites += [(902, 0.0, 0.0), (903, 3.0, -4.0)]
    want = {}
    for i, y, x in sites:
        near = [] if y is None else sorted((((y - b) ** 2 + (x - c) ** 2) ** 0.5, j) for j, b, c in anchors if b is not None)
        want[i] = near[0][1] if near and near[0][0] < 5 else None
    df = tariffs.nearest_anchor(spark.createDataFrame(sites, "site_id BIGINT, latitude DOUBLE, longitude DOUBLE"),
                                spark.createDataFrame(anchors, "anchor BIGINT, latitude DOUBLE, longitude DOUBLE"))
    assert {r.site_id: r.anchor for r in df.collect()} == want and want[901] is None
    assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_sketches_merge_to_bounded_ranks(spark):
    rnd = random.Random(4)
    rows = [(1 + i % 2, datetime(2024, 1, 1) + timedelta(minutes=i), rnd.choice([rnd.gauss(0, 1), 3.0])) for i in range(40_000)]
    df = spark.createDataFrame(rows + [(3, datetime(2024, 1, 2), None)], "site_id BIGINT, ts TIMESTAMP, production_kwh DOUBLE")
    days = sketches.daily_sketches(df, ["production_kwh"])
    probs = (0.01, 0.25, 0.5, 0.9)
    for first, last in ((None, None), ("2024-01-05", "2024-01-20")):
        part = df.where(F.to_date("ts").between(first or "2000-01-01", last or "2100-01-01"))
        errors = sketches.rank_errors(part, sketches.range_quantiles(days, probs, first, last), "production_kwh", probs).collect()
        assert len(errors) == 8 and all(r.rank_error <= sketches.RANK_ERROR for r in errors)
        assert sum(r.n for r in errors) == 4 * part.where("production_kwh IS NOT NULL").count()
    small = sketches.range_quantiles(days, (0.5,), by=("column",)).first()
    assert small.n == 40_000  # the fleet, from its sites


def test_timeline_is_read_once(spark, intervals_of):
    rows = [(1, f"2024-01-0{d} {h:02d}:{m}", 1.0, 1.0, 0.0, 0.0) for d in (1, 2) for h in range(24) for m in ("00", "15", "30", "45") if (d, h) != (2, 5)]
    rows += [(1, "2024-01-01 00:00", 1.0, 1.0, 0.0, 0.0), (2, "2024-01-01 00:00", 1.0, 1.0, 0.0, 0.0)]
    df = intervals_of(rows)
    whole = {r.site_id: r for r in timeline.timeline_summary(df).collect()}
    assert (whole[1].records, whole[1].expected_seconds, whole[1].gaps_detected, whole[1].largest_gap_seconds) == (189, 900, 1, 4500)
    assert whole[1].span_seconds == 2 * 86400 - 900 and (whole[2].records, whole[2].expected_seconds) == (1, None)
    told = timeline.temporal_completeness(df).collect()
    assert [(r.site_id, r.actual_records, r.expected_records, r.missing_intervals) for r in told] == [(1, 189, 192, 3)]
    old = {(r.site_id, r.step_seconds): r.n for r in timeline.steps(df).groupBy("site_id", "step_seconds").agg(F.sum("n").alias("n")).collect()}
    assert {(r.site_id, r.step_seconds): r.n for r in timeline.step_counts(df).where("step_seconds IS NOT NULL").collect()} == old
    stored = work_path(spark, "readings")
    df.write.parquet(stored)
    assert plan_of(timeline.temporal_completeness(spark.read.parquet(stored))).count("FileScan") == 1


def test_nearest_anchor_meets_few_of_a_crowd(spark):
    """Anchors stand close together: a site is not held against all of them."""
    rnd = random.Random(4)
    crowd = [(i, 40 + rnd.random() * 2, -100 + rnd.random() * 2) for i in range(3000)]
    crowd += [(5000 + i, 40.0, -100.0) for i in range(3)] + [(6000, 30.0, -100.0), (6001, float("nan"), 1.0)]
    sites = [(i, 38 + rnd.random() * 6, -103 + rnd.random() * 8) for i in range(150)] + [(900, 40.0, -100.0), (901, 31.0, -101.0), (902, 0.0, 0.0), (903, None, 1.0)]
    got = tariffs.nearest_anchor(spark.createDataFrame(sites, "site_id BIGINT, latitude DOUBLE, longitude DOUBLE"),
                                 spark.createDataFrame(crowd, "anchor BIGINT, latitude DOUBLE, longitude DOUBLE"))
    told = {r.site_id: (r.anchor, r.anchor_distance) for r in got.collect()}
    for site, lat, lon in sites:
        near = [] if lat is None else [(math.sqrt((lat - y) ** 2 + (lon - x) ** 2), a) for a, y, x in crowd if x == x and y == y]
        near = min([n for n in near if n[0] < 5], default=(None, None))
        assert told[site][0] == near[1] and told[site][1] == (near[0] if near[0] is None else pytest.approx(near[0])), site
    assert told[900][0] == 5000
    assert tariffs._depth(spark.createDataFrame([c[1:] for c in crowd[:3000]], "_lat DOUBLE, _lon DOUBLE"),
                          lambda c, k: F.floor(F.col(c) * 4.0 ** k / 5)) >= 2
