"""Clusterings, I-2MC, I-FC, gamma shapes, Fisher vectors, kernel machines and cut recordings against brute force and planted values."""

import math
import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gazeloom.operators import grouped, learning
from gazeloom.operators import kernels as K
from gazeloom.plans import kernels


def _dbscan(pts, eps, fewest):
    near = np.hypot(pts[:, None, 0] - pts[:, 0], pts[:, None, 1] - pts[:, 1]) <= eps
    core = near.sum(1) >= fewest
    label, k = np.full(len(pts), -1), 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & (label < 0)):
                    label[j] = k
                    if core[j]:
                        stack.append(int(j))
            k += 1
    return label


@pytest.mark.parametrize("seed", range(12))
def test_dbscan_by_cells_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    pts = rng.uniform(0, 100, (n, 2)) if seed % 3 else np.round(rng.normal(50, 12, (n, 2)))
    eps, fewest = float(rng.choice([1.0, 3.0, 5.0, 9.0])), int(rng.integers(1, 9))
    assert K.dbscan(pts, eps, fewest).tolist() == _dbscan(pts, eps, fewest).tolist()
    assert K.dbscan(np.zeros((0, 2)), eps).tolist() == []


@pytest.mark.parametrize("seed", range(6))
def test_mean_shift_by_cells_equals_all_distances(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    pts = np.concatenate([rng.normal(c, 3, (40, 2)) for c in rng.uniform(0, 100, (4, 2))])
    whole = [K.mean_shift(pts, b, orphans=o).tolist() for b in (6.0, 20.0) for o in (True, False)]
    peaks = K.density_peaks(pts, 8.0).tolist()
    monkeypatch.setattr(K, "HELD_DISTANCES", 300)
    assert [K.mean_shift(pts, b, orphans=o).tolist() for b in (6.0, 20.0) for o in (True, False)] == whole
    assert K.density_peaks(pts, 8.0).tolist() == peaks


def test_many_points_in_one_task():
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(c, 12, (20_000, 2)) for c in ((100, 100), (300, 80), (500, 300), (120, 400), (420, 420))])
    began = time.time()
    label = K.dbscan(pts, 3.0, 5)
    assert time.time() - began < 60
    big = np.bincount(label[label >= 0])
    assert (big > 10_000).sum() == 5 and (label < 0).sum() < 2_000


def test_affinity_with_neighbours_only():
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(c, 2, (25, 2)) for c in ((10, 10), (60, 20), (30, 80))])
    whole = K.affinity_propagation(pts)
    assert K.affinity_propagation(pts, neighbours=len(pts) - 1).tolist() == whole.tolist()
    near = K.affinity_propagation(pts, neighbours=40)
    assert len({tuple(sorted(set(near[k : k + 25].tolist()))) for k in (0, 25, 50)}) == 3 and not set(near[:25]) & set(near[25:50])
    with pytest.raises(ValueError):
        K.affinity_propagation(np.zeros((K.AFFINITY_POINTS + 1, 2)))


def test_two_means_weights_by_hand():
    # a step between samples 4 and 5: each window that holds it gives its change a weight of one at each rate
    x, y = np.repeat([0.0, 10.0], 5), np.zeros(10)
    w = K.two_means_weights(x, y, 5, 2)
    # windows around 2, 4, 6, 8, cut at the ends: 0-4, 2-6, 4-8, 6-9; only 2-6 and 4-8 have a change
    # 2-6: full rate at 5; half rate (2, 4, 6) at 6; 4-8: full at 5, half (4, 6, 8) at 6 and 7; quarter rates have two samples
    assert w.tolist() == [0, 0, 0, 0, 0, pytest.approx(2 / 2), pytest.approx((1 + 1) / 3), pytest.approx(1 / 2), 0, 0]
    fix = np.array([1, 1, 0, 1, 1, 0, 0, 1, 1, 1])
    at = np.array([0, 0, 5, 1, 1, 9, 9, 30, 30, 30.0])
    assert K.merged_runs(fix, at, np.zeros(10), 1, 2.0).tolist() == [1, 1, 1, 1, 1, 0, 0, 1, 1, 1]
    assert K.merged_runs(fix, at, np.zeros(10), 2, 99.0).tolist() == [0] * 7 + [1, 1, 1]
    assert K.merged_runs(fix, at, np.zeros(10), 1, 99.0).tolist() == [1] * 10
    # the limit is 0.217 + 0.355, so samples 5 and 6 move; 7 to 9 start too far from 4 to be merged
    assert K.two_means_fixations(x, y, 5, 2, 1, 5.0).tolist() == [1] * 5 + [0, 0, 1, 1, 1]


def test_gamma_with_a_free_start():
    rng = np.random.default_rng(2)
    for shape, start, scale in ((4.0, 10.0, 2.0), (9.0, 50.0, 1.0), (2.5, 0.0, 5.0)):
        found = K.gamma_shape_shifted(start + rng.gamma(shape, scale, 20_000))
        assert found == pytest.approx(shape, rel=0.12)
    assert all(math.isnan(K.gamma_shape_shifted(np.array(v))) for v in ([1.0, 2.0], [3.0, 3.0, 3.0], [-1.0, 0.0, np.nan, 2.0, 3.0]))


def test_saccade_shapes_have_a_row_for_each(spark, sf):
    got = kernels.QUERIES["saccade_gamma_skewness"](spark, sf).toPandas()
    sac = kernels.C.QUERIES["saccade_events"](spark, sf).select("recording_id", "a", "b").toPandas()
    assert sorted(map(tuple, got[["recording_id", "a", "b"]].to_numpy().tolist())) == sorted(map(tuple, sac.to_numpy().tolist()))
    assert got.gamma_skewness[got.b - got.a < 3].isna().all()


def _model(rng, k=3):
    cov = np.stack([np.diag(rng.uniform(2, 6, 2)) + 0.5 for _ in range(k)])
    trans = rng.uniform(0.2, 1, (k, k))
    return {"pi": np.full(k, 1 / k), "transitions": trans / trans.sum(1, keepdims=True), "means": rng.uniform(0, 12, (k, 2)), "covariances": cov}


def test_fisher_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    model, pts = _model(rng), rng.uniform(0, 12, (25, 2))
    by_trans, by_mean, by_cov, occupancy, joint = K.hmm_gradient(model, pts)
    assert occupancy.sum() == pytest.approx(25) and joint.sum() == pytest.approx(24)

    def slope(key, at, also=None):
        sides = []
        for h in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in model.items()}
            moved[key][at] += h
            if also:
                moved[key][also] += h
            sides.append(K.hmm_moments(moved, pts)[2])
        return (sides[0] - sides[1]) / 2e-5

    for i in range(3):
        for j in range(3):
            assert by_trans[i, j] == pytest.approx(slope("transitions", (i, j)), rel=1e-4, abs=1e-5)
        for d in range(2):
            assert by_mean[i, d] == pytest.approx(slope("means", (i, d)), rel=1e-4, abs=1e-5)
            assert by_cov[i, d, d] == pytest.approx(slope("covariances", (i, d, d)), rel=1e-4, abs=1e-5)
        assert 2 * by_cov[i, 0, 1] == pytest.approx(slope("covariances", (i, 0, 1), (i, 1, 0)), rel=1e-4, abs=1e-5)


def test_fisher_options():
    rng = np.random.default_rng(4)
    model, pts = _model(rng), rng.uniform(0, 12, (25, 2))
    v = K.fisher_vector(model, pts)
    assert len(v) == 9 + 3 * (2 + 3) and np.linalg.norm(v) == pytest.approx(1)
    assert len(K.fisher_vector(model, pts, upper=False)) == 9 + 3 * (2 + 4)
    assert not np.allclose(v, K.fisher_vector(model, pts, by_row=False))
    far = model | {"means": np.vstack([model["means"][:2], [[1e4, 1e4]]])}
    assert (K.fisher_vector(far, pts)[-5:] == 0).all() and not np.isnan(K.fisher_vector(far, pts)).any()
    # a state without samples has a constant covariance term only if it is not left out
    assert K.fisher_vector(model, pts, least=1e9)[9:].tolist() == [0.0] * 15


def test_ifc_names_and_learning_width(spark, sf):
    g = kernels.gaze(spark, sf)
    assert grouped.ifc_features(g, 1.0).columns == ["recording_id", "i", *K.IFC] and list(K.IFC) == sorted(K.IFC) and len(K.IFC) == 16
    flat = {c: np.zeros(1) for c in ("x", "y", "theta_x", "theta_y", "ux", "uy", "uz", "speed")}
    assert K.ifc_features(flat, 500.0)[1].shape == (1, 16)
    assert {r.n for r in grouped.features(g, "ifc").select(F.size("features").alias("n")).distinct().collect()} == {16}


def test_kernel_machine_agrees_with_the_exact_kernel(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(360, 2))
    y = 1.0 + (np.hypot(*x.T) > 1.1) + (np.hypot(*x.T) > 1.8)
    df = spark.createDataFrame([(1, k, [float(v) for v in p], float(c)) for k, (p, c) in enumerate(zip(x, y, strict=True))], "recording_id long, i long, f array<double>, label double").withColumn("vector", array_to_vector("f"))
    model = learning.KernelMachine(2, gamma=1.0, size=400).fit(df.where("i < 240"), rounds=40)
    got = {r.i: float(r.prediction) for r in model.transform(df.where("i >= 240")).select("i", "prediction").collect()}
    z = (x - x[:240].mean(0)) / x[:240].std(0, ddof=1)
    gram = np.exp(-((z[:, None] - z[:240]) ** 2).sum(2))
    near = learning.fourier_features(z, model.directions, model.phases)
    assert np.abs(near @ near[:240].T - gram).mean() < 0.06
    score = []
    for c in (1.0, 2.0, 3.0):
        sign, a, bias = np.where(y[:240] == c, 1.0, -1.0), np.zeros(240), 0.0
        for step in range(1, 3001):  # hinge loss of the exact kernel by subgradients
            out = sign * (gram[:240] @ a + bias) < 1
            rate = 20 / (step + 20)
            a = (1 - 1e-3 * rate) * a + rate * 0.02 * out * sign
            bias += rate * 0.02 * (out * sign).sum()
        score.append(gram[240:] @ a + bias)
    exact = np.argmax(score, 0) + 1.0
    agree = np.mean([got[k] == exact[k - 240] for k in range(240, 360)])
    assert agree >= 0.93 and np.mean([got[k] == y[k] for k in range(240, 360)]) >= 0.9


def test_learned_labels_with_duration_limits(spark):
    class Said:
        """A model that repeats a column."""

        def transform(self, df):
            return df.withColumn("prediction", F.col("i") * 0.0 + F.element_at(F.array(*map(F.lit, SAID)), (F.col("i") + 1).cast("int")))

    SAID = [1, 1, 2, 3, 3, 3, 1, 2, 2, 1, 1, 1]
    g = spark.createDataFrame([(1, k, float(k), 0.0, 1.0, 1.0) for k in range(12)], "recording_id long, i long, x double, y double, speed double, status double")
    ask = lambda **o: [r.label for r in learning.predict(g, Said(), fs=1.0, **o).orderBy("i").collect()]
    assert ask() == SAID
    assert ask(limits={"fix": (2.0, 9.0), "pursuit": (3.0, 9.0)}) == [1, 1, 2, 3, 3, 3, 2, 2, 2, 1, 1, 1]
    assert ask(limits={"fix": (3.0, 9.0), "pursuit": (4.0, 9.0)}) == [2] * 9 + [1] * 3
    assert ask(limits={"min_fix": 2.0, "max_fix": 9.0, "min_sac": 1.0}, task="binary") == [2] * 9 + [1] * 3
    with pytest.raises(ValueError):
        ask(limits={}, task="other")


def test_cut_recordings_have_equal_labels(spark):
    rng = np.random.default_rng(6)
    n = 400
    x = np.cumsum(np.where(rng.random(n) < 0.1, 200, rng.normal(0, 2, n)))
    speed = np.abs(np.diff(x, append=x[-1]))
    df = spark.createDataFrame([(r, k, float(x[k]), 0.0, 1.0, float(speed[k])) for r in (1, 2) for k in range(n)], "recording_id long, i long, x double, y double, status double, speed double")
    want = K.velocity_dispersion(x, np.zeros(n), speed, 100.0, 4, 15.0).tolist()
    run = lambda g: __import__("pandas").DataFrame({"i": g.i, "status": g.status, "label": K.velocity_dispersion(g.x.to_numpy(), g.y.to_numpy(), g.speed.to_numpy(), 100.0, 4, 15.0)})
    for most in (1, 20, 10_000):  # a cut at every place where one is possible, at some, at none
        got = grouped.by_parts(df, run, F.col("speed") > 100.0, most).orderBy("recording_id", "i").collect()
        assert [r.label for r in got] == want * 2 and len(set(want)) == 4
