"""Kernels that take many recordings at once against one recording at a time; features are made once for a fit."""

import numpy as np
import pandas as pd
import pytest

from gazeloom.operators import convnet, grouped, learning
from gazeloom.operators import kernels as K

SIZES = (1, 2, 3, 7, 40, 1, 66)
BOUNDS = np.concatenate([[0], np.cumsum(SIZES)])


def _points():
    rng = np.random.default_rng(4)
    x, y = np.round(rng.exponential(60, BOUNDS[-1]), 2), rng.integers(0, 100, BOUNDS[-1]).astype(float)
    x[BOUNDS[3] : BOUNDS[4]] = y[BOUNDS[3] : BOUNDS[4]] = 4.0
    return x, y, np.abs(np.gradient(x))


@pytest.mark.parametrize("kernel", ["i2mc", "weights", "directions", "sample", "ifc"])
def test_many_equal_one_at_a_time(kernel):
    x, y, speed = _points()
    unit = np.stack([x, y, np.full(len(x), 600.0)])
    g = {"x": x, "y": y, "theta_x": x / 10, "theta_y": y / 7, "speed": speed} | dict(zip(("ux", "uy", "uz"), unit / np.linalg.norm(unit, axis=0), strict=True))
    fn = {
        "i2mc": lambda s, b: K.two_means_fixations(x[s], y[s], 9, 2, 1, 60.0, bounds=b),
        "weights": lambda s, b: K.two_means_weights(x[s], y[s], 21, 3, bounds=b),
        "directions": lambda s, b: K.direction_histograms(x[s], y[s], 5, bounds=b),
        "sample": lambda s, b: K.sample_features(x[s], y[s], speed[s], 5, 1, bounds=b)[1],
        "ifc": lambda s, b: K.ifc_features({k: v[s] for k, v in g.items()}, 60.0, bounds=b)[1],
    }[kernel]
    one = np.concatenate([fn(slice(a, b), None) for a, b in zip(BOUNDS, BOUNDS[1:], strict=False)])
    np.testing.assert_allclose(fn(slice(None), BOUNDS), one, rtol=1e-12, atol=1e-12)


def test_sample_features_by_definition():
    x, y, speed = (v[BOUNDS[4] : BOUNDS[5]] for v in _points())
    names, got = K.sample_features(x, y, speed, 5, 1)
    for i in range(len(x)):
        w, s = slice(max(0, i - 5), i + 6), slice(max(0, i - 1), i + 2)
        xs, ys = x[w], y[w]
        step = np.hypot(np.diff(xs), np.diff(ys))
        dist = np.hypot(xs - xs.mean(), ys - ys.mean())
        before, after = slice(max(0, i - 5), i + 1), slice(i, i + 6)
        cov = np.cov(xs, ys)
        want = {
            "acceleration": np.abs(np.gradient(speed))[s].max(),
            "bcea": 2 * np.pi * 1.1394342831883648 * np.sqrt(np.linalg.det(cov)),
            "delta_mean": np.hypot(x[after].mean() - x[before].mean(), y[after].mean() - y[before].mean()),
            "delta_median": np.hypot(np.median(x[after]) - np.median(x[before]), np.median(y[after]) - np.median(y[before])),
            "dispersion": np.ptp(xs) + np.ptp(ys),
            "distance_mean": dist.mean(),
            "distance_median": np.median(dist),
            "rayleigh_z": len(step) * ((np.diff(xs) / step).mean() ** 2 + (np.diff(ys) / step).mean() ** 2),
            "rms": np.sqrt((step**2).mean()),
            "std": np.sqrt(np.trace(cov)),
            "velocity": speed[s].max(),
        }
        assert names == sorted(want)
        assert got[i] == pytest.approx([want[k] for k in names], rel=1e-9, abs=1e-9)


def test_batches_hold_whole_recordings(spark):
    x, y, _ = _points()
    rows = [(None if k == 4 else 100 - k, i, float(x[a + i])) for k, (a, n) in enumerate(zip(BOUNDS, SIZES, strict=False)) for i in range(n)]
    df = spark.createDataFrame(rows, "recording_id long, i long, x double").repartition(3)
    want = {}
    for key, i, v in rows:
        want.setdefault(key, []).append(v)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        at_once = grouped.per_batch(df, lambda g, b: ({"xs": pd.Series([g.x[p:q].tolist() for p, q in zip(b, b[1:], strict=False)]), "sent": np.full(len(b) - 1, len(b) - 1)}, np.arange(len(b) - 1)), "xs array<double>, sent int", ["x"], rows=20)
        got = at_once.collect()
        each = grouped.per_recording(df, lambda g: pd.DataFrame({"xs": [g.x.tolist()]}), "xs array<double>", ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(each) == len(SIZES)
    assert {r.recording_id: r.xs for r in got} == {r.recording_id: r.xs for r in each} == want


def test_features_are_held_while_fitted(spark, monkeypatch):
    seen = []
    inner = learning._fit_rows
    monkeypatch.setattr(learning, "_fit_rows", lambda rows, classifier: (seen.append(rows), seen.append(rows.is_cached), inner(rows, classifier))[2])
    gaze = spark.createDataFrame([(r, i, float((i * 37 + r) % 50), float(i % 9), float(i % 5)) for r in range(4) for i in range(30)], "recording_id long, i long, x double, y double, speed double")
    truth = gaze.selectExpr("recording_id", "i", "CAST(1 + i % 2 AS INT) AS label")
    model = learning.fit(gaze, truth)
    assert seen[1] and not seen[0].storageLevel.useMemory
    assert learning.predict(gaze, model).count() == 120


def test_affinity_ends_early_where_the_rest_is_known():
    x, y, _ = _points()
    pts = np.stack([x, y], 1)[BOUNDS[6] :]
    assert K.affinity_propagation(pts, rounds=1000).tolist() == K.affinity_propagation(pts, rounds=10**7).tolist()


def test_the_net_takes_a_bounded_number_of_jobs(spark, monkeypatch):
    """Two classes told by the direction of the last step; more steps than jobs."""
    monkeypatch.setattr(convnet, "JOBS", 12)
    rng = np.random.default_rng(2)
    rows = []
    for r in range(12):
        label = np.repeat(rng.integers(1, 3, 20), 10)
        x = np.cumsum(np.where(label == 1, 3.0, -3.0) + rng.normal(0, 0.5, 200))
        rows += [(r, i, float(x[i]), float(rng.normal()), int(label[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "recording_id long, i long, x double, y double, label int").repartition(3, "recording_id").cache()
    fitted = convnet.fit(df.where("recording_id < 8"), df.select("recording_id", "i", "label"), window=9, channels=(6,), kernels=(4,), hidden=8, epochs=8, batch=64, rate=1e-2)
    assert len(fitted.losses) == 12 and fitted.losses[-1] < 0.5 * fitted.losses[0]
    got = fitted.transform(df.where("recording_id >= 8")).join(df, ["recording_id", "i"])
    assert got.selectExpr("avg(CAST(prediction = label AS DOUBLE)) AS a").first().a > 0.85
    df.unpersist()
