"""Ties, rounding and whole jobs at larger sizes."""

import numpy as np

from gazeloom.operators import kernels as K


def test_dispersion_at_the_limit_is_summed_as_in_sql():
    x, y = np.array([204.98, 90.98, 90.98]), np.array([72.0, 78.0, 78.0])
    below = (204.98 - 90.98) + 78.0 - 72.0 < 120.0
    assert below != ((204.98 - 90.98) + (78.0 - 72.0) < 120.0)
    assert (K.velocity_dispersion(x, y, np.zeros(3), 250.0, 2, 120.0).tolist()[0] == 1) == below


def test_density_peaks_of_mirrored_points_equal_their_sql():
    import duckdb
    import pandas as pd

    from gazeloom.plans import kernels as queries

    rows, sets = [], []
    for r in range(200):
        rng = np.random.default_rng(r)
        half = np.stack([rng.integers(0, 250, r % 7 + 2), rng.integers(0, 100, r % 7 + 2)], 1).astype(float)
        pts = rng.permutation(np.concatenate([half, np.stack([500 - half[:, 0], half[:, 1]], 1)]))
        sets.append(pts)
        rows += [(r, k, x, y) for k, (x, y) in enumerate([*pts.tolist(), (0.0, 0.0)])]
    at = pd.DataFrame(rows, columns=["user_id", "k", "value", "y"])
    events = pd.DataFrame({"event_id": at.index, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at.k, "s"), "user_id": at.user_id, "event_type": "view", "value": at.value, "props": [f'{{"k": {int(y)}}}' for y in at.y]})  # noqa: F841
    want = {}
    for r, k, a in duckdb.sql(queries.ORACLE_SQL["aoi_density_peaks"]).fetchall():
        want[r, k] = a
    got = {(r, k): a for r, pts in enumerate(sets) for k, a in enumerate(K.area_names(K.density_peaks(pts, 0.1 * queries.DIAGONAL)))}
    assert got == want


def _columns(kernel, one, v, ids, vs):
    out = {}
    for c in kernel(one, v, ids, vs):
        n = len(c[1])
        for r in zip(*[x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() if hasattr(x, "tolist") else [x] * n for x in c], strict=True):
            out.setdefault(r[1], []).append(r[2:])
    return out


def test_batches_of_partners_equal_pair_by_pair(monkeypatch):
    from gazeloom.operators import batches, grouped

    rng = np.random.default_rng(5)
    centers = {"A": (50.0, 20.0), "B": (200.0, 70.0), "C": (400.0, 30.0), "D": (480.0, 90.0)}
    monkeypatch.setattr(batches, "DIAGONAL", 40)
    for _ in range(15):
        n, sizes = int(rng.integers(1, 14)), rng.integers(1, 14, 7)
        ids = np.arange(10, 17)
        p, ps = rng.integers(0, 6, 2 * n).astype(float), [rng.integers(0, 6, 2 * int(m)).astype(float) for m in sizes]
        s, ss = rng.choice(list("ABC"), n).astype(object), [rng.choice(list("ABCD"), int(m)).astype(object) for m in sizes]
        for kind in ("dtw", "frechet"):
            got = _columns(batches.WarpLinks(kind), 1, p, ids, ps)
            for i, w in zip(ids.tolist(), ps, strict=True):
                far, links = K.warp_links(p.reshape(-1, 2), w.reshape(-1, 2), kind)
                assert got[i] == [(far, [a for a, _ in links], [b for _, b in links])]
        for kernel, align in ((batches.Alignments(), K.edit_alignment), (batches.LocalAlignments(), K.local_alignment)):
            mine, *theirs = kernel.start([s, *ss])
            got = _columns(kernel, 1, mine, ids, theirs)
            for i, w in zip(ids.tolist(), ss, strict=True):
                score, places = align(list(s), list(w))
                assert got[i] == [(score, [(s[a] if a >= 0 else "_") + (w[b] if b >= 0 else "_") for a, b in places])]
        kernel, measures = batches.EditMeasures(centers), grouped.edit_metrics(centers)
        mine, *theirs = kernel.start([s, *ss])
        got = _columns(kernel, 1, mine, ids, theirs)
        for i, w in zip(ids.tolist(), ss, strict=True):
            assert [m for m, _ in got[i]] == list(measures)
            assert np.allclose([x for _, x in got[i]], [f(list(s), list(w)) for f in measures.values()], atol=1e-12)


def test_pairs_in_batches_have_the_sums_of_each_pair():
    from gazeloom.operators import batches, pairwise

    rng = np.random.default_rng(3)
    ids, sizes = np.arange(10, 19), rng.integers(1, 40, 9)
    p, ps = rng.integers(0, 30, 44).astype(float), [rng.integers(0, 30, 2 * int(m)).astype(float) for m in sizes]
    ps[0] = ps[0] - 100.0
    got = _columns(pairwise.joint_bins(8, 8), 1, p, ids, ps)
    for i, w in zip(ids.tolist(), ps, strict=True):
        q, want = w.reshape(-1, 2), []
        wide = np.maximum(p.reshape(-1, 2).max(0), q.max(0)) + 0.001
        for side, z in ((1, p.reshape(-1, 2)), (2, q)):
            cell, count = np.unique(np.floor(np.minimum(z, wide - 0.001) / (wide / 8)).astype(int), axis=0, return_counts=True)
            want += [(side, *c, n) for c, n in zip(cell.tolist(), count.tolist(), strict=True)]
        assert sorted(got[i]) == sorted(want)
    for segment in (16, None):
        kernel = batches.CrossSpectra(1.0, segment)
        mine, *theirs = kernel.start([p[:6], *ps, ps[1][:3]])
        got = _columns(kernel, 1, mine, np.append(ids, 19), theirs)
        for i, w in zip([*ids.tolist(), 19], [*ps, ps[1][:3]], strict=True):
            n = max(len(mine[0]), len(w))
            x, y = (np.pad(z, (0, n - len(z))) for z in (mine[0], w))
            f, s = K.spectral_density(x, y, 1.0, segment)
            assert np.allclose([r[1:4] for r in got[i]], np.stack([f, s.real, s.imag], 1), atol=1e-9)
            assert [r[0] for r in got[i]] == list(range(len(f)))
            assert segment is None or np.allclose([r[4] for r in got[i]], K.coherency(x, y, 1.0, segment)[1], atol=1e-9)
    for kind, limit in (("frechet", 25.0), ("dtw", 200.0)):
        far = batches.warp_within(p.reshape(-1, 2), ps, limit, kind)
        assert np.allclose(far, [K.warp_within(p.reshape(-1, 2), w.reshape(-1, 2), limit, kind) for w in ps])


def test_cells_of_many_points_fill_the_plane():
    rng = np.random.default_rng(1)
    pts = np.round(rng.uniform(0, 1, (400, 2)) * (500, 100), 2)
    areas = K.voronoi_areas(np.concatenate([pts, pts[:50]]), 500.0, 100.0)
    assert len(areas) == len(np.unique(pts, axis=0)) and np.isclose(areas.sum(), 50_000.0) and (areas > 0).all()


def test_best_clusters_share_one_table_of_distances(monkeypatch):
    pts = np.random.default_rng(2).uniform(0, 100, (60, 2))
    found = [K.kmeans(pts, k) for k in range(2, 16)]
    best = max(found, key=lambda z: K.silhouette(pts, z))
    made, whole = [], K.silhouette
    monkeypatch.setattr(K, "silhouette", lambda p, z, d: made.append(d) or whole(p, z, d))
    assert (K.kmeans_auto(pts) == best).all() and all(d is made[0] for d in made)
