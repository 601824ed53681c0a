"""Live operators over files that arrive one by one, against the same rows read at once."""

import datetime as dt

import pandas as pd
import pytest

from gazeloom.streaming import live

BASE = dt.datetime(2024, 1, 1)
at = lambda ms: BASE + dt.timedelta(milliseconds=ms)
MS = int(pd.Timestamp(BASE).value // 1_000_000)


@pytest.fixture
def stream(spark, tmp_path):
    def make(parts, schema):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
        # one batch of files in a trigger, in the order of arrival
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    return make


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        q.stop()
    return spark.table(name).collect()


def test_live_labels_carry_the_previous_sample(spark, stream):
    xs = [0.0, 0.1, 0.1, 5.0, 5.4, 5.4]
    rows = [(7, at(100 * k), x, 0.0) for k, x in enumerate(xs)] + [(8, at(0), 1.0, 1.0)]
    schema = "recording_id long, t timestamp, x double, y double"
    out = drain(spark, live.live_ivvt(stream([rows[:3], rows[3:]], schema), fast=20, slow=2, fs=10), "labels_out")
    got = {(r.recording_id, r.t): r.label for r in out}
    assert [got[7, at(100 * k)] for k in range(6)] == [1, 1, 1, 2, 3, 1] and got[8, at(0)] == 1 and len(got) == 7


def test_live_events_close_across_batches(spark, stream):
    labels = [1, 1, 2, 2, 2, 1, 3]
    rows = [(7, at(100 * k), v) for k, v in enumerate(labels)]
    out = drain(spark, live.live_events(stream([rows[:4], rows[4:]], "recording_id long, t timestamp, label int")), "events_out")
    assert sorted((r.recording_id, r.label, r.start_ms - MS, r.end_ms - MS, r.n) for r in out) == [(7, 1, 0, 100, 2), (7, 1, 500, 500, 1), (7, 2, 200, 400, 3)]


def test_live_dwell_and_visits(spark, stream):
    # the second file's last row moves the watermark beyond all windows of the others
    first = [(at(ms), 7, a) for ms, a in [(0, "A"), (500, "A"), (900, "B"), (3000, "A")]]
    second = [(at(3500), 7, "A"), (at(60_000), 7, "Z")]
    samples = stream([first, second], "t timestamp, recording_id long, aoi string")
    dwell = drain(spark, live.live_dwell(samples), "dwell_out")
    assert sorted((r.aoi, r.n) for r in dwell) == [("A", 4), ("B", 1)]
    visits = drain(spark, live.live_visits(samples), "visits_out")
    assert sorted((r.aoi, r.session_window.start, r.n) for r in visits) == [("A", at(0), 2), ("A", at(3000), 2), ("B", at(900), 1)]
