"""Methods by name, areas with small ones merged, sequences from raw gaze, spectra of one segment, masks."""

import numpy as np
import pytest

from gazeloom.operators import grouped, learning, registry
from gazeloom.operators import kernels as K
from gazeloom.plans import catalog as C
from gazeloom.plans import kernels


def test_segmentation_by_name_equals_the_queries(spark, sf):
    g = kernels.gaze(spark, sf)
    two, three = kernels.TWO, kernels.THREE
    asked = {
        "ivt": registry.segment(g, "I_VT", C.FS, two, threshold=C.SLOW),
        "ivvt": registry.segment(g, "I_VVT", C.FS, three, saccade=C.FAST, pursuit=C.SLOW),
        "ivmp": registry.segment(g, "I_VMP", C.FS, three, saccade=C.FAST, rayleigh=0.5, window=4.0),
        "idit": registry.segment(g, "I_DiT", C.FS, two, **kernels.IDIT),
        "ivdt": registry.segment(g, "I_VDT", C.FS, three, **kernels.IVDT),
    }
    for name, got in asked.items():
        want = (C.QUERIES | kernels.QUERIES)[name](spark, sf).select("recording_id", "i", "label")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name
    with pytest.raises(ValueError):
        registry.segment(g, "I_RF", C.FS)
    assert set(registry.BINARY) & set(registry.TERNARY) == set()


def test_areas_by_name_merge_small_ones(spark):
    rng = np.random.default_rng(0)
    made = [(10, 10, 12), (60, 15, 9), (14, 30, 5), (90, 90, 7)]
    rows = [(1, x, y) for x, y, n in made for _ in range(n)]
    df = spark.createDataFrame([(r, k, float(x + rng.normal(0, 0.5)), float(y + rng.normal(0, 0.5)), 1.0) for k, (r, x, y) in enumerate(rows)], "recording_id long, k long, x double, y double, dur double")
    plain = registry.areas(df, "I_DT", 100.0).collect()
    assert sorted(np.unique([r.aoi for r in plain], return_counts=True)[1].tolist()) == [5, 7, 9, 12]
    merged = registry.areas(df, "I_DT", 100.0, fewest=6).orderBy("k").collect()
    assert len({r.aoi for r in merged}) == 3 and merged[0].aoi == merged[22].aoi and len({r.aoi for r in merged[:12]}) == 1
    own = [r for r in merged if r.aoi == merged[0].aoi]
    assert len(own) == 17 and own[0].cx == pytest.approx(np.mean([r.x for r in own]))
    assert len({r.aoi for r in registry.areas(df, "I_DT", 100.0, fewest=99).collect()}) == 4
    with pytest.raises(ValueError):
        registry.areas(df, "none", 100.0)


def test_names_of_many_areas():
    assert K.area_names(np.array([0, 25])) == ["A", "Z"]
    assert K.area_names(np.array([0, 7, 120])) == ["A000", "A007", "A120"] and K.area_names(np.zeros(0, int)) == []


def test_sequences_from_raw_gaze(spark, sf):
    g = kernels.gaze(spark, sf)
    got = kernels.QUERIES["aoi_sequences_from_gaze"](spark, sf)
    paths = C.QUERIES["scanpath_from_fixations"](spark, sf)
    assert got.count() == paths.count() and got.select("aoi", "cx", "cy").distinct().count() == got.select("aoi").distinct().count()
    assert got.columns == registry.sequences(g, "I_DT", C.FS, C.SLOW, 100.0, joint=False, limits=kernels.TWO).columns


def test_one_segment_cross_spectrum(spark):
    rng = np.random.default_rng(1)
    series = {3: rng.normal(size=20), 8: rng.normal(size=14)}
    df = spark.createDataFrame([(r, k, float(v)) for r, x in series.items() for k, v in enumerate(x)], "recording_id long, i long, x double")
    got = grouped.cross_spectra(df, 10.0, None).orderBy("cell").collect()
    x, y = series[3], np.pad(series[8], (0, 6))
    taper = np.hanning(21)[:-1]
    a, b = (np.fft.rfft((z - z.mean()) * taper) for z in (x, y))
    want = np.conj(a) * b / (10.0 * (taper**2).sum())
    want[1:-1] *= 2
    assert [r.re for r in got] == pytest.approx(want.real.tolist()) and [r.im for r in got] == pytest.approx(want.imag.tolist())
    assert [r.frequency for r in got] == pytest.approx((np.arange(11) / 2).tolist()) and all(r.coherency is None for r in got)


def test_masks_of_training_samples(spark, sf):
    g = kernels.gaze(spark, sf)
    truth = g.selectExpr("recording_id", "i", "CAST(1 + i % 3 AS INT) AS label", "i < 20 AS chosen")
    model = learning.fit(g, truth, mask="chosen AND label > 1")
    assert {r.label for r in learning.predict(g, model).select("label").distinct().collect()} <= {2, 3}


def test_recurrence_and_entropy_in_pieces(monkeypatch):
    from gazeloom.operators import pairwise

    rng = np.random.default_rng(2)
    p, e = rng.uniform(0, 50, (60, 2)), rng.normal(size=80)
    whole = pairwise.recurrence(p, 9.0), K.approximate_entropy(e, 2, 0.8)
    monkeypatch.setattr(pairwise, "CELLS", 50)
    monkeypatch.setattr(K, "HELD_DISTANCES", 50)
    assert (pairwise.recurrence(p, 9.0), K.approximate_entropy(e, 2, 0.8)) == whole
    assert np.isnan(pairwise.recurrence(p[:1], 9.0)["recurrence_rate"]) and np.isnan(K.approximate_entropy(e[:2], 2, 0.8))
