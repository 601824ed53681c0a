"""Alignments, warpings, joint areas, cleaned readers and event modes against brute force and hand-computed values."""

from functools import lru_cache

import numpy as np
import pytest

from gazeloom.operators import grouped, learning
from gazeloom.operators import kernels as K
from gazeloom.plans import kernels
from gazeloom.sources import readers


def _edit(a, b, deletion, insertion, cost):
    @lru_cache(None)
    def best(i, j):
        if not i or not j:
            return i * deletion + j * insertion
        return min(best(i - 1, j - 1) + cost(i - 1, j - 1), best(i - 1, j) + deletion, best(i, j - 1) + insertion)

    return best(len(a), len(b))


def _warp(d, join):
    @lru_cache(None)
    def best(i, j):
        if not i and not j:
            return d[0, 0]
        return join(d[i, j], min(best(u, v) for u, v in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if u >= 0 and v >= 0))

    return best(d.shape[0] - 1, d.shape[1] - 1)


@pytest.mark.parametrize("seed", range(12))
def test_programs_equal_recursions(seed):
    rng = np.random.default_rng(seed)
    a, b = (list(rng.choice(list("ABC"), rng.integers(0, 9))) for _ in range(2))
    cost = lambda i, j: 0.0 if a[i] == b[j] else 0.75
    for deletion, insertion in ((1.0, 1.0), (0.5, 0.25)):
        far, places = K.edit_alignment(a, b, deletion, insertion, cost)
        assert far == K.weighted_levenshtein(a, b, deletion, insertion, cost) == _edit(a, b, deletion, insertion, cost)
        assert [i for i, _ in places if i >= 0] == list(range(len(a))) and [j for _, j in places if j >= 0] == list(range(len(b)))
        assert sum(deletion if j < 0 else insertion if i < 0 else cost(i, j) for i, j in places) == far
    assert K.needleman_wunsch(a, b, 0.0, 1.0) == -K.weighted_levenshtein(a, b)
    s, t = (rng.integers(0, 9, (rng.integers(1, 8), 2)).astype(float) for _ in range(2))
    d = np.hypot(s[:, None, 0] - t[None, :, 0], s[:, None, 1] - t[None, :, 1])
    for kind, join in (("dtw", lambda x, y: x + y), ("frechet", max)):
        far, links = K.warp_links(s, t, kind)
        assert far == pytest.approx(_warp(d, join))
        assert links[0] == (0, 0) and links[-1] == (len(s) - 1, len(t) - 1)
        assert all((u - i, v - j) in ((1, 1), (1, 0), (0, 1)) for (i, j), (u, v) in zip(links, links[1:], strict=False))
        along = [d[i, j] for i, j in links]
        assert far == pytest.approx(sum(along) if kind == "dtw" else max(along))


@pytest.mark.parametrize("seed", range(12))
def test_local_alignment_equals_all_gaps(seed):
    rng = np.random.default_rng(seed)
    a, b = (list(rng.choice(list("ABCD"), rng.integers(0, 10))) for _ in range(2))
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            gaps = [h[i - k, j] - 0.1 - 0.05 * k for k in range(1, i + 1)] + [h[i, j - k] - 0.1 - 0.05 * k for k in range(1, j + 1)]
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), *gaps)
    score, places = K.local_alignment(a, b)
    assert score == pytest.approx(h.max()) == K.smith_waterman(a, b)
    cost, run = 0.0, None
    for i, j in places:
        side = "b" if j < 0 else "a" if i < 0 else None
        cost += (1 if a[i] == b[j] else -1) if side is None else -0.05 - (0.1 if side != run else 0)
        run = side
    assert cost == pytest.approx(score)


def test_empty_sequences():
    assert K.edit_alignment([], []) == (0.0, []) and K.edit_alignment(["A"], []) == (1.0, [(0, -1)])
    assert K.local_alignment([], ["A"]) == (0.0, [])
    assert K.warp_links(np.zeros((0, 2)), np.zeros((2, 2)))[1] == []


def test_centres_must_agree():
    assert grouped.same_centers({"A": (0, 1)}, {"A": (0, 1)}) == {"A": (0, 1)}
    for other in ({"A": (0, 2)}, {"B": (0, 1)}, {}):
        with pytest.raises(ValueError):
            grouped.same_centers({"A": (0, 1)}, other)


def test_joint_areas(spark):
    rng = np.random.default_rng(0)
    rows = [(r, k, float(x + rng.normal(0, 2)), float(y + rng.normal(0, 2))) for r in (1, 2) for k, (x, y) in enumerate([(10, 10), (400, 20), (200, 90)] * 8)]
    got = learning.joint_areas(spark.createDataFrame(rows, "recording_id long, k long, x double, y double")).collect()
    assert len(got) == len(rows) and {(r.k % 3, r.aoi) for r in got} == {(0, "A"), (1, "C"), (2, "B")}
    one = learning.joint_areas(spark.createDataFrame(rows[:1], "recording_id long, k long, x double, y double")).collect()
    assert [(r.aoi, r.cx) for r in one] == [("A", rows[0][2])]
    assert learning.joint_areas(spark.createDataFrame([], "recording_id long, k long, x double, y double")).count() == 0


def test_alignment_queries(spark, sf):
    seqs = {r.recording_id: r.s for r in kernels.scanpath(spark, sf).groupBy("recording_id").agg({"k": "count"}).withColumnRenamed("count(k)", "s").collect()}
    for name in ("aoi_alignments", "scanpath_dtw_links"):
        rows = kernels.QUERIES[name](spark, sf).collect()
        assert len(rows) == len(seqs) * (len(seqs) - 1) // 2
        for r in rows[:20]:
            if name == "aoi_alignments":
                assert sum(p[0] != "_" for p in r.aligned) == seqs[r.id_1] and sum(p[1] != "_" for p in r.aligned) == seqs[r.id_2] and sum(p[0] != p[1] for p in r.aligned) == r.score
            else:
                assert (r.left[-1], r.right[-1]) == (seqs[r.id_1] - 1, seqs[r.id_2] - 1)
    total = kernels.QUERIES["aoi_hmm_transitions"](spark, sf).groupBy("recording_id", "src").agg({"p": "sum"}).collect()
    assert total and all(r["sum(p)"] == pytest.approx(1) for r in total)


def test_cleaned_recordings(spark, tmp_path):
    cols = "recording string, i long, x double, y double, label int, near string"
    rows = [("a", i, float(i * i), 1.0, 0 if i in (0, 3, 4, 9) else 1, "n") for i in range(10)] + [("b", i, 0.0, 0.0, 0, "n") for i in range(3)]
    got = {r.i: (r.x, r.near) for r in readers.cleaned(spark.createDataFrame(rows, cols), 0.5).collect() if r.recording == "a"}
    assert [got[i][0] for i in (0, 1, 3, 4, 9)] == [None, 1, 11, 18, 64] and got[0][1] == "n"
    assert readers.cleaned(spark.createDataFrame(rows, cols), 0.3).count() == 0
    turned = readers.degrees_cleaned(spark.createDataFrame([("a", i, 0.0, 45.0, v) for i, v in enumerate((3, 2, 1, 1, 1, 1, 1, 1, 1, 5))], "recording string, i long, x double, y double, label int")).orderBy("i").collect()
    assert [r.label for r in turned][:2] == [1, 2] and turned[-1].label == 0 and turned[0].x == 266.5 and turned[0].y == pytest.approx(715.5)
    body = "".join(f"{i * 2000},{10 + i},20,1,FIX,FIX\n" for i in range(39))
    (tmp_path / "a.arff").write_text("@RELATION g\n%@METADATA width_px 100\n%@METADATA height_px 50\n%@METADATA width_mm 200\n%@METADATA height_mm 100\n%@METADATA distance_mm 600\n@DATA\n" + body + "90000,120,20,1,SP,SP\n")
    rows = readers.gaze_arff_cleaned(spark, str(tmp_path / "a.arff")).orderBy("i").collect()
    assert (rows[0].x, rows[0].y) == (20 - 100 + 237.5, 40 - 50 + 140) and rows[-1].label == 0 and rows[-1].x == rows[-2].x
    assert readers.gaze_arff_cleaned(spark, str(tmp_path / "a.arff"), most_noise=0.01).count() == 0


def test_noise_and_orphans():
    pts = np.array([(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (50, 50), (6, 6)], float)
    label = K.dbscan(pts, 2.0)
    assert label.tolist() == [0] * 5 + [-1, -1] and K.to_nearest_centre(pts, label).tolist() == [0] * 7
    assert K.to_nearest_centre(pts, np.full(7, -1)).tolist() == [-1] * 7
    line = np.array([(x, 0) for x in range(0, 60, 4)], float)
    for reach in (5.0, 13.0):
        every, near = K.mean_shift(line, reach), K.mean_shift(line, reach, orphans=False)
        assert (every >= 0).all() and ((near == every) | (near == -1)).all()


def test_phase_difference(spark):
    t = np.arange(64) / 64
    rows = [(1, i, float(np.sin(2 * np.pi * 5 * v + 0.2)), float(np.sin(2 * np.pi * 5 * v + 0.9))) for i, v in enumerate(t)] + [(2, 0, 1.0, 1.0)]
    got = {r.recording_id: r.phase for r in grouped.phase_difference(spark.createDataFrame(rows, "recording_id long, i long, x double, tx double"), 64).collect()}
    assert abs(np.angle(np.exp(1j * (got[1] - 0.7)))) < 1e-3 and got[2] is None


def test_smoothing_by_name():
    from gazeloom.functions import kinematics as kin
    from gazeloom.functions.relational import Plan

    assert all("s_x" in kin.smoothed(Plan(), "g", "out", m).steps["out"] for m in kin.SMOOTHINGS)
    with pytest.raises(ValueError):
        kin.smoothed(Plan(), "g", "out", "median")


def test_metrics_by_centres():
    centers = {"A": (0.0, 0.0), "B": (3.0, 4.0), "C": (0.0, 10.0)}
    by_place = lambda s, t: lambda i, j: float(np.hypot(*np.subtract(centers[s[i]], centers[t[j]]))) / 10.0
    s, t = list("ABCAB"), list("BCA")
    got = {k: f(s, t) for k, f in grouped.edit_metrics(centers).items()}
    assert got["generalized_edit"] == pytest.approx(K.weighted_levenshtein(s, t, 0.3, 0.3, by_place(s, t)) / 5)
    assert got["needleman_wunsch"] == pytest.approx(-K.needleman_wunsch(s, t, 0.1, 0.25, by_place(s, t)) / 5)
    assert got["smith_waterman"] == pytest.approx(K.smith_waterman(s, t, lambda i, j: 0.2 - by_place(s, t)(i, j)) / (5 * 2.0))
    plain = {k: f(s, t) for k, f in grouped.edit_metrics().items()}
    assert plain["levenshtein"] == got["levenshtein"] == K.weighted_levenshtein(s, t) / 5
    assert plain["smith_waterman"] == K.smith_waterman(s, t) / 5
    assert all(f([], []) == 0 for m in (None, centers) for f in grouped.edit_metrics(m).values())


def test_symbols_of_any_kind():
    a, b = [(0, 1), (2, 3), (0, 1)], [(0, 1), (0, 1)]
    assert K.weighted_levenshtein(a, b) == 1 and K.needleman_wunsch(a, b, 1.0, 0.5) == 1.5 and K.smith_waterman(a, b) == pytest.approx(1.85)
    assert K.weighted_levenshtein([(0, 1)], [0, 1]) == 2
    s = np.array([(10, 10, 1.0), (60, 40, 2.0), (90, 90, 1.0)])
    assert K.scanmatch(s, s, 100, 100) == pytest.approx(1)
