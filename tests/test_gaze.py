"""Kernels against hand-computed values, plans against DuckDB, readers and invariants."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from gazeloom.operators import islands
from gazeloom.functions.relational import Plan
from gazeloom.operators import kernels as K
from gazeloom.functions import kinematics as kin
from gazeloom.operators import aois, segmentation
from gazeloom.plans import catalog, kernels

LETTERS = ["XMJYXUZ", "MZJXJYAWXU", "MZJAJYYAWXU", "AWXJYAW", "MZJAWXU", "XMJYAUZ"]
LCS = {(0, 1): 5, (0, 2): 5, (0, 3): 3, (0, 4): 4, (0, 5): 6, (1, 2): 9, (1, 3): 5, (1, 4): 7, (2, 4): 7, (4, 5): 4}
LEV = {(0, 1): 7, (0, 2): 8, (0, 3): 6, (0, 4): 5, (0, 5): 1, (1, 2): 2, (1, 3): 5, (1, 4): 3, (2, 4): 4, (4, 5): 6}


def test_edit_and_subsequence_goldens():
    assert K.weighted_levenshtein(list("kitten"), list("sitting")) == 3
    for (i, j), n in LCS.items():
        assert len(K.longest_common_subsequence(list(LETTERS[i]), list(LETTERS[j]))) == n
    for (i, j), n in LEV.items():
        assert K.weighted_levenshtein(list(LETTERS[i]), list(LETTERS[j])) == n


def test_transition_entropies():
    got = K.transition_entropies(np.array([[1 / 3, 1 / 3, 1 / 3], [1, 0, 0], [0, 0, 0]]))
    assert got["stationary"] == pytest.approx(1.0397207708)
    assert got["joint"] == pytest.approx(1.8636799873)
    assert got["mutual_information"] == pytest.approx(0.2157615543)


def test_shapes_and_spectra():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2.0]])
    assert K.polygon_area(K.convex_hull(square)) == 16
    assert K.voronoi_areas(square, 4, 4).sum() == pytest.approx(16)
    t = np.arange(256) / 256
    f, p = K.spectral_density(np.sin(2 * np.pi * 16 * t), np.sin(2 * np.pi * 16 * t), 256, None, "boxcar")
    assert f[p.real.argmax()] == 16 and p.real.sum() == pytest.approx(0.5, rel=1e-6)
    a, w, _, c = K.sine_fit(t, 3 * np.sin(2 * np.pi * 4.2 * t + 0.3) + 1)
    assert abs(a) == pytest.approx(3, rel=1e-4) and w == pytest.approx(2 * np.pi * 4.2, rel=1e-4) and c == pytest.approx(1, abs=1e-3)
    s = np.array([[0, 0, 1], [1, 0, 1], [2, 1, 1.0]])
    assert K.dtw(s, s) == 0 and K.discrete_frechet(s, s) == 0
    assert all(v == pytest.approx(1) for v in K.multimatch(s * [100, 100, 1], s * [100, 100, 1], 500).values())
    assert K.sublevel_bars(np.array([0, 2, 1, 3.0])) == [(0.0, 3.0), (1.0, 2.0)]


def test_gamma_shape_recovers():
    v = np.random.default_rng(0).gamma(2.5, 1.0, 4000)
    assert K.gamma_shape(v) == pytest.approx(2.5, rel=0.1)


def test_islands(spark):
    p = Plan().then("g", "SELECT CAST(1 AS BIGINT) AS recording_id, CAST(i AS BIGINT) AS i, 1.0 AS status FROM {s}")
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 9)], "i long")
    run = lambda *a: [(r.a, r.b) for r in islands.runs(p, "g", "out", "1 = 1", *a).spark(spark, s=rows).orderBy("a").collect()]
    assert run() == [(0, 2), (5, 6), (9, 9)]
    assert run(1) == [(0, 2), (5, 6)]
    assert run(0, 2) == [(5, 6), (9, 9)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL | kernels.ORACLE_SQL))
def test_query_equals_duckdb(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    a, b = (catalog.QUERIES | kernels.QUERIES)[name](spark, sf).toPandas(), con.execute((catalog.ORACLE_SQL | kernels.ORACLE_SQL)[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    show = lambda f: sorted(tuple("-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (float, np.number, int)) else str(v) for v in r) for r in f[cols].astype(object).itertuples(index=False))
    assert show(a) == show(b)


def _rows(con, plan, table, values):
    con.execute(f"CREATE OR REPLACE VIEW given AS SELECT * FROM (VALUES {values}) t({table})")
    return con.execute(plan.duckdb()).fetchall()


def test_goldens_of_plans():
    con = duckdb.connect()
    src = Plan().then("g", "SELECT CAST(1 AS BIGINT) AS recording_id, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 600.0 AS z, 1.0 AS status FROM given")
    got = _rows(con, kin.kinematics(src, "g", "k", 10.0, 0, 0).then("out", "SELECT speed FROM k ORDER BY i"), "i, x, y", "(0, 0, 0), (1, 3, 4), (2, 3, 4)")
    assert [r[0] for r in got] == [50, 0, 0]
    got = _rows(con, kin.moving_average(src, "g", "m", 3).then("out", "SELECT s_x FROM m ORDER BY i"), "i, x, y", ", ".join(f"({k}, {k + 1}, 0)" for k in range(6)))
    assert [r[0] for r in got] == [3, 3, 3, 3, 4, 5]
    slow = Plan().then("g", "SELECT CAST(1 AS BIGINT) AS recording_id, CAST(i AS BIGINT) AS i, 1.0 AS status, fix FROM given")
    got = _rows(con, islands.two_class(slow, "g", "lab", "fix = 1", 10.0, 0.3, 2.0, 0.0).then("out", "SELECT label FROM lab ORDER BY i"), "i, fix", "(0, 1), (1, 0), " + ", ".join(f"({k}, 1)" for k in range(2, 10)))
    assert [r[0] for r in got] == [2, 2] + [1] * 8
    seq = Plan().then("s", "SELECT CAST(1 AS BIGINT) AS recording_id, CAST(k AS BIGINT) AS k, aoi, CAST(dur AS DOUBLE) AS dur FROM given")
    got = _rows(con, aois.collapse(seq, "s", "c").then("out", "SELECT aoi, dur FROM c ORDER BY k"), "k, aoi, dur", "(0, 'A', 1), (1, 'A', 2), (2, 'B', 3), (3, 'B', 4), (4, 'A', 5)")
    assert got == [("A", 3), ("B", 7), ("A", 5)]
    got = _rows(con, segmentation.three_class(segmentation.ivvt(kin.kinematics(src, "g", "k", 1.0, 0, 0), "k", "v", 5, 1), "v", "lab", 1.0, (2.0, 9.0), (2.0, 9.0)).then("out", "SELECT label FROM lab ORDER BY i"), "i, x, y", "(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 9, 0), (4, 11, 0), (5, 13, 0), (6, 13.5, 0)")
    assert [r[0] for r in got] == [1, 1, 2, 3, 3, 1, 1]


def test_simplified_scanpath():
    p = np.array([(0, 0, 0.1), (10, 0, 0.1), (20, 0, 0.1), (20, 50, 1), (20, 51, 0.1)])
    assert K.simplify_scanpath(p, 5, 35, 0.4) == pytest.approx(np.array([(0, 0, 20, 0, 0.2), (20, 0, 0, 50, 0.1)]))
    assert K.simplify_scanpath(p[:1], 5, 35, 0.4).shape == (0, 5) and K.simplify_scanpath(p[:2], 50, 35, 0.4).shape == (0, 5)


def test_scan_goldens():
    flat = np.zeros(7)
    x = np.array([0, 0, 0, 10, 10.1, 10.2, 30])
    assert K.dispersion_windows(x, flat, 2, 1.0).tolist() == [1, 1, 1, 1, 1, 1, 0]
    assert K.dispersion_windows(x[:5], flat[:5], 4, 1.0).tolist() == [0, 0, 0, 1, 1]
    assert K.velocity_dispersion(x, flat, np.array([0, 0, 9, 0, 0, 9, 0.0]), 5, 2, 1.0).tolist() == [3, 3, 2, 3, 3, 2, 3]
    assert K.velocity_dispersion(x, flat, np.zeros(7), 5, 2, 1.0).tolist() == [1, 1, 1, 0, 1, 1, 0]
    assert K.kalman_windows(flat, flat, flat, flat, 1.0, 1.0, 1.0, 3, 0.0).tolist() == [1] * 7
    # one step by hand: q = 1, gains 1/2 and 0/2, so the speed stays until the second update
    assert K.kalman_gains(3, 1.0, 1.0, 1.0).tolist() == [[0, 0], [0.5, 0], [pytest.approx(2.5 / 3.5), pytest.approx(1 / 3.5)]]
    rows = K.transition_entropies(np.array([[0.5, 0.5], [1.0, 0.0]]))
    assert rows["conditional_by_row"] == [pytest.approx(np.log(2)), 0] and sum(rows["mutual_information_by_row"]) == pytest.approx(rows["mutual_information"])
    assert rows["stationary"] == pytest.approx(rows["conditional"] + rows["mutual_information"])


def test_readers(spark, tmp_path):
    from gazeloom.sources import readers

    (tmp_path / "g.csv").write_text("gazeX,gazeY\n1,2\n3,4\n5,6\n")
    got = readers.gaze_csv(spark, str(tmp_path / "g.csv")).orderBy("i").collect()
    assert [(r.i, r.x, r.y, r.z, r.status) for r in got] == [(0, 1, 2, 1000, 1), (1, 3, 4, 1000, 1), (2, 5, 6, 1000, 1)]
    (tmp_path / "a.arff").write_text("@RELATION g\n%@METADATA width_px 100\n%@METADATA height_px 50\n%@METADATA width_mm 200\n%@METADATA height_mm 100\n%@METADATA distance_mm 600\n@DATA\n0,10,20,1,FIX,FIX\n2000,120,20,1,SP,SP\n")
    rows = readers.gaze_arff(spark, str(tmp_path / "a.arff")).orderBy("i").collect()
    assert [(r.x, r.y, r.label, r.off_screen) for r in rows] == [(20, 40, 1, False), (240, 40, 3, True)]
