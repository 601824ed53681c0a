"""The convolutional net: gradients, fit across partitions, held-out labels against the perceptron's."""

import numpy as np
import pytest

from gazeloom.operators import convnet, learning


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    net = convnet.Net(3, window=21, channels=(3, 4), kernels=(4, 3), hidden=6)
    w, x, y = net.start(1), rng.normal(size=(5, 2, 21)), np.array([0, 2, 1, 1, 0])
    _, grad = net.gradient(w, x, y)
    for k, g in enumerate(grad):
        assert g.shape == w[k].shape
        for at in rng.choice(g.size, min(g.size, 12), False):
            step, sides = 1e-6, []
            for s in (step, -step):
                moved = [v.copy() for v in w]
                moved[k].ravel()[at] += s
                sides.append(net.gradient(moved, x, y)[0])
            assert g.ravel()[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-5)


def test_published_shapes_and_windows():
    net = convnet.Net(3)
    assert net.shapes[-4:] == [(256 * 6, 3000), (3000,), (3000, 3), (3,)]
    x = np.arange(5.0)
    got = convnet.windows(x, 10 * x, np.array([0, 2, 4]), 5, (1.0, 10.0))
    assert got[:, 0].tolist() == got[:, 1].tolist() == [[0, 0, 0, 1, 2], [-2, -1, 0, 1, 2], [-2, -1, 0, 0, 0]]
    with pytest.raises(ValueError):
        convnet.windows(x, x, np.array([0]), 4, (1, 1))
    with pytest.raises(ValueError):
        convnet.Net(2, window=31)


def _gaze(spark, recordings):
    """Fixations, saccades and slow pursuits under so much noise that a sample's next neighbours tell little."""
    rng = np.random.default_rng(1)
    rows = []
    for r in range(recordings):
        x, y, label, p = [], [], [], rng.uniform(100, 400, 2)
        while len(x) < 240:
            kind = int(rng.integers(1, 4))
            n = {1: 40, 2: 6, 3: 40}[kind]
            turn = rng.uniform(0, 2 * np.pi)
            step = {1: 0.0, 2: 14.0, 3: 0.9}[kind] * np.array([np.cos(turn), np.sin(turn)])
            for _ in range(n):
                p = p + step
                x.append(p[0] + rng.normal(0, 4))
                y.append(p[1] + rng.normal(0, 4))
                label.append(kind)
        rows += [(r, k, float(a), float(b), int(c)) for k, (a, b, c) in enumerate(zip(x, y, label, strict=True))]
    df = spark.createDataFrame(rows, "recording_id long, i long, x double, y double, label int")
    speed = "coalesce(sqrt(power(x - lag(x) OVER (PARTITION BY recording_id ORDER BY i), 2) + power(y - lag(y) OVER (PARTITION BY recording_id ORDER BY i), 2)), 0.0)"
    return df.selectExpr("*", f"{speed} AS speed")


def test_beats_the_perceptron_on_held_out_recordings(spark):
    df = _gaze(spark, 24).repartition(3, "recording_id").cache()
    gaze, truth = df.drop("label"), df.select("recording_id", "i", "label")
    train = gaze.where("recording_id < 16")
    right = {}
    for kind in ("cnn", "mlp"):
        model = learning.fit(train, truth, classifier=kind, **({"net": {"window": 41, "channels": (12, 16), "kernels": (8, 4), "hidden": 32, "epochs": 24, "batch": 768, "rate": 4e-3}} if kind == "cnn" else {}))
        got = learning.predict(gaze.where("recording_id >= 16"), model).join(truth.withColumnRenamed("label", "truth"), ["recording_id", "i"])
        right[kind] = got.selectExpr("avg(cast(label = truth AS double)) AS a").first().a
        if kind == "cnn":
            assert np.mean(model.losses[-8:]) < 0.6 * np.mean(model.losses[:4])
    assert right["cnn"] > right["mlp"] and right["cnn"] > 0.7
    df.unpersist()
