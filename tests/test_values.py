"""Models, fractal dimensions, areas and measures against their definitions: every path, every pair, every point."""

import itertools
import math

import numpy as np
import pytest

from gazeloom.operators import kernels as K


def _posteriors(start, trans, density):
    """States' and transitions' probabilities and the likelihood, summed over all paths."""
    n, k = density.shape
    gamma, xi, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * density[0, path[0]]
        for t in range(1, n):
            p *= trans[path[t - 1], path[t]] * density[t, path[t]]
        total += p
        for t, j in enumerate(path):
            gamma[t, j] += p
        for a, b in itertools.pairwise(path):
            xi[a, b] += p
    return gamma / total, xi / total, total


@pytest.mark.parametrize("seed", range(4))
def test_speed_model_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(30, 12, 4), rng.normal(240, 60, 3), rng.normal(40, 15, 1)])
    mean, var, start, trans = np.array([50.0, 250.0]), np.full(2, 5000.0), np.full(2, 0.5), np.full((2, 2), 0.5)
    density = lambda: np.exp(-0.5 * (v[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
    for _ in range(3):
        gamma, xi, _ = _posteriors(start, trans, density())
        start, trans = gamma[0], xi / xi.sum(1, keepdims=True)
        mean = (gamma * v[:, None]).sum(0) / gamma.sum(0)
        var = np.maximum((gamma * (v[:, None] - mean) ** 2).sum(0) / gamma.sum(0), 1e-6)
    a, t, e = np.log(start + 1e-9), np.log(trans + 1e-9), np.log(density() + 1e-9)
    score = lambda s: a[s[0]] + e[0, s[0]] + sum(t[s[i - 1], s[i]] + e[i, s[i]] for i in range(1, len(s)))
    slow = np.array(max(itertools.product((0, 1), repeat=len(v)), key=score)) == mean.argmin()
    want = slow | np.append(False, slow[:-1])
    assert K.gaussian_hmm_1d(v, 50.0, 250.0, 5000.0, rounds=3).tolist() == want.astype(int).tolist()
    assert want.any() and not want.all()


@pytest.mark.parametrize("seed", range(3))
def test_area_model_equals_all_paths(seed):
    rng = np.random.default_rng(seed)
    pts = np.concatenate([rng.normal((100, 40), 12, (4, 2)), rng.normal((300, 60), 15, (3, 2))])
    first = K.kmeans(pts, 2)
    mean, cov = np.array([pts[first == j].mean(0) for j in (0, 1)]), np.stack([np.eye(2) * 2500.0] * 2)
    start, trans = np.full(2, 0.5), np.full((2, 2), 0.5)
    for _ in range(2):
        off = pts[:, None] - mean
        density = np.array([[math.exp(-0.5 * d @ np.linalg.solve(c, d)) / (2 * math.pi * math.sqrt(np.linalg.det(c))) for d, c in zip(row, cov, strict=True)] for row in off])
        gamma, xi, total = _posteriors(start, trans, density)
        start, trans = gamma[0], xi / xi.sum(1, keepdims=True)
        mean = gamma.T @ pts / gamma.sum(0)[:, None]
        cov = np.array([sum(g * np.outer(d, d) for g, d in zip(gamma[:, j], pts - mean[j], strict=True)) / gamma[:, j].sum() + 1e-6 * np.eye(2) for j in (0, 1)])
    got = K.gaussian_hmm_2d(pts, 2, rounds=2)
    assert got["log_likelihood"] == pytest.approx(math.log(total))
    for name, want in {"pi": start, "transitions": trans, "means": mean, "covariances": cov, "gamma": gamma}.items():
        assert np.allclose(got[name], want, rtol=1e-7, atol=1e-9), name


def test_higuchi_by_its_definition():
    v = np.random.default_rng(5).normal(0, 1, 41).cumsum()
    n, points = len(v), []
    for k in range(1, 11):
        lengths = []
        for m in range(1, k + 1):
            top = (n - m) // k
            lengths.append(sum(abs(v[m + i * k - 1] - v[m + (i - 1) * k - 1]) for i in range(1, top + 1)) * (n - 1) / (top * k))
        points.append((math.log(1 / k), math.log(sum(lengths) / k)))
    x, y = np.array(points).T
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    assert K.higuchi(v) == pytest.approx(slope)
    # without a second division by k a line has no dimension
    assert K.higuchi(np.arange(60.0)) == pytest.approx(0, abs=1e-9)


def test_voronoi_areas_by_counting():
    pts = np.random.default_rng(2).uniform((0, 0), (50, 30), (9, 2))
    gx, gy = np.meshgrid((np.arange(1000) + 0.5) / 20, (np.arange(600) + 0.5) / 20)
    nearest = ((gx[..., None] - pts[:, 0]) ** 2 + (gy[..., None] - pts[:, 1]) ** 2).argmin(-1)
    counted = np.bincount(nearest.ravel(), minlength=len(pts)) / 400
    assert np.allclose(sorted(K.voronoi_areas(pts, 50, 30)), sorted(counted), atol=0.6)


def test_hilbert_index_walks_through_neighbours():
    at = {K.hilbert_index(x, y, 4): (x, y) for x in range(16) for y in range(16)}
    assert sorted(at) == list(range(256))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))


def test_nearest_point_distance_by_loops():
    rng = np.random.default_rng(3)
    s, t = rng.uniform(0, 100, (6, 2)), rng.uniform(0, 100, (4, 2))
    near = lambda a, b: sum(min((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for q in b) for p in a)
    assert K._mannan_distance(s, t, 100, 50) == pytest.approx(math.sqrt((4 * near(s, t) + 6 * near(t, s)) / (2 * 6 * 4 * (100**2 + 50**2))))


def test_cell_alignment_by_recursion():
    rng = np.random.default_rng(4)
    s, t = (np.column_stack([rng.uniform(0, 500, n), rng.uniform(0, 100, n), rng.uniform(0.1, 0.9, n)]) for n in (4, 3))
    cells = lambda z: [(int(x // 25), int(y // 5)) for x, y, d in z for _ in range(math.ceil(d / 0.25))]
    a, b = cells(s), cells(t)
    fit = lambda u, v: 1 - 2 * math.dist(u, v) / math.hypot(19, 19)
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        table[i, j] = max(table[i - 1, j - 1] + fit(a[i - 1], b[j - 1]), table[i - 1, j], table[i, j - 1])
    assert K.scanmatch(s, t, 500, 100) == pytest.approx(table[-1, -1] / max(len(a), len(b)))


def test_silhouette_by_loops_and_centres_at_rest():
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(c, 8, (9, 2)) for c in ((20, 20), (90, 30), (60, 80))])
    label = K.kmeans_auto(pts)
    assert len(set(label.tolist())) == 3
    means = np.array([pts[label == k].mean(0) for k in range(3)])
    assert (((pts[:, None] - means) ** 2).sum(2).argmin(1) == label).all()
    widths = []
    for i, p in enumerate(pts):
        to = {k: [math.dist(p, q) for j, q in enumerate(pts) if label[j] == k and j != i] for k in range(3)}
        a, b = np.mean(to[label[i]]), min(np.mean(to[k]) for k in to if k != label[i])
        widths.append((b - a) / max(a, b))
    assert K.silhouette(pts, label) == pytest.approx(np.mean(widths))
