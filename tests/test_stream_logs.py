"""Timers, complete rollups and the compacted log, over several files and restarts."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import types as T

from heliofleet.schema import INTERVAL_SCHEMA
from heliofleet.streaming import live
from heliofleet.streaming.batch_log import BatchLog
from heliofleet.streaming.silence import SilenceWatch, silence_processor

START = datetime(2024, 1, 1)


def drop_file(folder, number, rows):
    """Rows (site, minutes after the start, production) as one file; files are read by time."""
    folder.mkdir(parents=True, exist_ok=True)
    file = folder / f"{number}.json"
    file.write_text("\n".join(json.dumps({"site_id": s, "ts": str(START + timedelta(minutes=m)), "production_kwh": p,
                                          "consumption_kwh": 1.0, "export_kwh": 0.0, "import_kwh": 0.0}) for s, m, p in rows))
    os.utime(file, (1_700_000_000 + 60 * number,) * 2)


def stream_of(spark, folder):
    return live.read_stream(spark, str(folder), INTERVAL_SCHEMA, "json", 1)


def minutes(t):
    return int((t - START).total_seconds() // 60)


def test_a_silent_site_alerts_by_timer(spark, tmp_path):
    folder = tmp_path / "in"
    # site 1 stops after 30 minutes; site 2 goes on, and a late row joins two of its runs
    drop_file(folder, 0, [(1, m, 1.0) for m in (0, 15, 30)] + [(2, 0, 1.0), (2, 30, 1.0)])
    drop_file(folder, 1, [(2, 15, 1.0), (2, 34, 1.0)])
    drop_file(folder, 2, [(2, m, 1.0) for m in (60, 75, 90)])
    watch = SilenceWatch(spark, stream_of(spark, folder), path=str(tmp_path / "out"))
    found = {(r.site_id, minutes(r.run_start), minutes(r.last_seen), r.readings, r.silent_before_seconds) for r in watch.run().collect()}
    assert found == {(1, 0, 30, 3, None), (2, 0, 34, 4, None)}  # the watermark is at 80 minutes
    # the same folders again: state and progress come from the checkpoint
    again = SilenceWatch(spark, stream_of(spark, folder), path=str(tmp_path / "out"))
    assert again.run().count() == 2
    drop_file(folder, 3, [(1, 125, 1.0)])
    told = {(r.site_id, minutes(r.run_start), r.silent_before_seconds) for r in again.run().collect()}
    assert told == {(1, 0, None), (2, 0, None), (2, 60, 26 * 60)}  # site 2 is silent since minute 90
    again.beat(str(START + timedelta(minutes=400)))
    last = [r for r in again.run().collect() if r.silent_before_seconds == 95 * 60]
    assert [(r.site_id, r.readings) for r in last] == [(1, 1)]  # no site reports any more


def test_a_site_has_one_timer_however_many_runs_are_open():
    class Values:
        def exists(self):
            return hasattr(self, "held")

        def get(self):
            return self.held

        def update(self, held):
            self.held = held

    class Handle:
        timers, calls = set(), 0

        def getValueState(self, *_):
            return Values()

        def registerTimer(self, ms):
            self.timers.add(ms)
            self.calls += 1

        def deleteTimer(self, ms):
            self.timers.discard(ms)
            self.calls += 1

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    class Reading:
        def __init__(self, ms):
            self.ms = ms
    site, handle = silence_processor(1000), Handle()
    site.init(handle)
    list(site.handleInputRows((7,), iter([Reading(5000 * i) for i in reversed(range(500))]), None))
    assert handle.timers == {1000} and handle.calls == 1
    out = list(site.handleExpiredTimer((7,), At(5000 * 300), At(1000)))
    assert [r["first"] for r in out] == [5000 * i for i in range(300)] and out[0].gap is None and {r.gap for r in out[1:]} == {5}
    assert handle.calls == 2 and 5000 * 300 + 1000 in handle.timers
    list(site.handleInputRows((7,), iter([Reading(5000 * 300 + 900)]), None))  # a late row joins the first open run
    assert 5000 * 300 + 1900 in handle.timers and 5000 * 300 + 1000 not in handle.timers
    assert len(list(site.handleExpiredTimer((7,), At(5000 * 500), At(5000 * 300 + 1900)))) == 200


@pytest.mark.parametrize("files", [1, 2, 6])
def test_rollup_is_complete_and_late_rows_correct_it(spark, tmp_path, files):
    rows = [(s, 60 * h, float(h % 7)) for h in range(0, 75) for s in (1, 2)]
    late = [(1, 60 * 10 + 1, 100.0)]
    ordered = rows[:100] + late + rows[100:]
    size = -(-len(ordered) // files)
    for i in range(files):
        drop_file(tmp_path / "in", i, ordered[i * size:(i + 1) * size])
    table = live.WindowTable(spark, str(tmp_path / "out"), "1 day", "3 days", fanout=3)
    got = {(r.site_id, minutes(r.window_start) // 1440): (r.production_kwh, r.readings) for r in table.run(stream_of(spark, tmp_path / "in")).collect()}
    want = defaultdict(lambda: [0.0, 0])
    for s, m, p in ordered:
        want[s, m // 1440][0] += p
        want[s, m // 1440][1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    assert (1, 3) in got  # the open window


SCHEMA = T.StructType([T.StructField("site_id", T.LongType()), T.StructField("day", T.DateType()), T.StructField("v", T.DoubleType())])


def batch_of(spark, rows):
    return spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(d), v) for s, d, v in rows], SCHEMA)


def state(log, *days):
    return {(r.site_id, (r.day - date(2024, 1, 1)).days): r.v for r in log.read(*days).collect()}


@pytest.mark.parametrize("rule", ["sum", "newest", "oldest"])
def test_log_merges_only_what_overlaps(spark, tmp_path, rule):
    log = BatchLog(spark, str(tmp_path / "log"), SCHEMA, ("site_id", "day"), "day", rule, fanout=3)
    want = {}
    for i in range(11):
        rows = [(s, 20 * i + d, float(i + 1)) for s in (1, 2) for d in (0, 1, 20)]
        log.commit(batch_of(spark, rows), i)
        for s, d, v in rows:
            old = want.get((s, d))
            want[s, d] = v if old is None else {"sum": old + v, "newest": v, "oldest": old}[rule]
        if i == 5:
            log.commit(batch_of(spark, rows), i)  # a replay
            before = log.manifest()
            log.commit(batch_of(spark, [(1, 0, 99.0)]), 2)  # and one of an older batch
            assert log.manifest() == before
    assert state(log) == want
    entries = log.manifest()["entries"]
    assert max(e["level"] for e in entries) == 2 and len({(e["first_batch"], e["last_batch"]) for e in entries}) <= 6
    # a read for some days opens their folders only
    few = log.read("2024-02-10", "2024-02-20")
    opened = {os.path.dirname(f.removeprefix("file://")) for f in few.inputFiles()}
    assert opened and all("part=2024-02" in f or "part=2024-01" in f for f in opened) and len(opened) < len(entries)
    for e in entries:
        path = os.path.join(log.path, e["folder"])
        assert (path in opened) == (e["first_day"] <= "2024-02-20" and e["last_day"] >= "2024-02-10")
    assert state(log, "2024-02-10", "2024-02-20") == {k: v for k, v in want.items() if 40 <= k[1] <= 50}


def test_compaction_survives_a_crash_before_its_manifest(spark, tmp_path, monkeypatch):
    log = BatchLog(spark, str(tmp_path / "log"), SCHEMA, ("site_id", "day"), "day", "sum", fanout=2)
    log.commit(batch_of(spark, [(1, 0, 1.0)]), 0)
    with monkeypatch.context() as m:
        m.setattr(BatchLog, "_save", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.commit(batch_of(spark, [(1, 0, 2.0), (1, 40, 5.0)]), 1)
    assert state(log) == {(1, 0): 1.0}
    log.commit(batch_of(spark, [(1, 0, 2.0), (1, 40, 5.0)]), 1)  # the stream replays the batch
    assert state(log) == {(1, 0): 3.0, (1, 40): 5.0}
    gone = log.vacuum()
    assert {"batch-0", "batch-1"} <= set(gone) and state(log) == {(1, 0): 3.0, (1, 40): 5.0}


def test_empty_batches_and_an_empty_log(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), SCHEMA, ("site_id", "day"), "day", "sum")
    assert state(log) == {}
    log.commit(batch_of(spark, []), 0)
    assert state(log) == {} and log.manifest()["last_batch"] == 0
