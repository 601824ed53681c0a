"""The neighbour classifier against all distances to all training samples."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from gazeloom.operators import learning
from gazeloom.operators.neighbours import Leaves


def voted(z, train, label, k):
    """Votes of the k nearest by distance, then label."""
    out = []
    for p in z:
        d = sum((p[j] - train[:, j]) ** 2 for j in range(z.shape[1]))
        near = np.lexsort((label, d))[:k]
        out.append(int(np.bincount(label[near]).argmax()))
    return out


@pytest.mark.parametrize("most", [None, 400])
def test_all_training_samples_vote(spark, most):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(7000, 3)), 2), rng.integers(0, 4, 7000)  # labels without a pattern: a sample of them votes otherwise
    x[6000:6200] = x[:200]  # equal samples
    df = spark.createDataFrame([(1 + i // 100, i, p.tolist(), float(c)) for i, (p, c) in enumerate(zip(x, y, strict=True))], "recording_id long, i long, f array<double>, label double").withColumn("vector", array_to_vector("f"))
    model = learning.fit_neighbours(df.where("i < 6600"), **({"most": most} if most else {}))
    assert (len(model.cells) > 8) == bool(most)
    got = {r.i: int(r.prediction) for r in model.transform(df.where("i >= 6500")).collect()}
    mean, sd = x[:6600].mean(0), x[:6600].std(0, ddof=1)
    z = (x - mean) / sd
    want = dict(zip(range(6500, 7000), voted(z[6500:], z[:6600], y[:6600], 3), strict=True))
    # ties of distances on the grid of two decimals fall by rounding
    assert len(got) == 500 and sum(got[i] != want[i] for i in want) <= 2


def test_leaves_find_the_nearest():
    rng = np.random.default_rng(7)
    points, labels = rng.integers(0, 9, (900, 4)).astype(float), rng.integers(0, 5, 900)
    x = rng.integers(-2, 12, (80, 4)).astype(float)
    far, near = Leaves(points, labels, 16).nearest(x, np.full(80, np.inf), 3)
    for p, d, c in zip(x, far, near, strict=True):
        all_ = ((points - p) ** 2).sum(1)
        order = np.lexsort((labels, all_))[:3]
        assert d.tolist() == all_[order].tolist() and c.tolist() == labels[order].tolist()
    # fewer points than neighbours, and a bound
    far, near = Leaves(points[:2], labels[:2]).nearest(points[:1], np.array([0.0]), 3)
    assert far[0, 0] == 0 and near[0, 0] == labels[0] and (near[0, 1:] == -1).all()
