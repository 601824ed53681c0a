"""Queries that need sequential or numeric kernels; checked by rows in the driver and by values in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aois, common, grouped, learning, mining, pairwise, registry, signals
from ..operators import kernels as K
from . import catalog as C
from . import checks

DIAGONAL = (C.WIDTH**2 + C.HEIGHT**2) ** 0.5


def _of(plan, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.then("result", f"SELECT * FROM {name}").spark(spark, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(C.KIN, "kin", spark, sf_dir)


def scanpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(C.PATH, "path", spark, sf_dir)


#: Post-processing for gaze made of events, as in the catalogue.
TWO, THREE = {"min_fix": 1.0, "max_fix": 1000.0, "min_sac": 0.0}, {"fix": (1.0, 1000.0), "pursuit": (1.0, 1000.0)}


def _labels(method: str, **p):
    return lambda s, d: grouped.segment(gaze(s, d), method, C.FS, THREE if method == "ivdt" else TWO, **p)


IKF = {"dt": 1.0, "sigma_1": 50.0, "sigma_2": 60.0, "window": 4, "limit": 4e4}
IDIT = {"window": 2, "limit": 80.0}
IVDT = {"fast": C.FAST, "window": 2, "limit": 120.0}
IDET = {"eps": 80.0, "window": 5, "min_points": 3}
I2MC = {"window": 9, "step": 2, "shortest": 1, "distance": 60.0}
IMST = {"window": 10, "eps": 60.0, "min_points": 3}
#: Lengths of the segments of detrended fluctuation.
SCALES = [4, 6, 8, 12, 16]

METRICS = grouped.path_metrics(C.WIDTH, C.HEIGHT, DIAGONAL, step=100_000.0, rounds=1000)
CENTERS = {"A": (50.0, 20.0), "B": (200.0, 70.0), "C": (400.0, 30.0), "D": (480.0, 90.0), "E": (250.0, 50.0)}


def _entropies(s: SparkSession, d: str) -> DataFrame:
    """A row an area: its own entropy and information, and those of the recording."""
    found = grouped.entropies(_of(aois.transitions(C.SEQ, "seq", "tr"), "tr", s, d))
    rows = found.withColumn("row", F.explode(F.arrays_zip("aois", "conditional_by_row", "mutual_information_by_row")))
    own = [F.col(f"row.{c}").alias(name) for c, name in (("aois", "aoi"), ("conditional_by_row", "conditional_of_area"), ("mutual_information_by_row", "mutual_information_of_area"))]
    return _four(rows.select("recording_id", *own, "stationary", "joint", "conditional", "mutual_information"))


def _hmm_transitions(s: SparkSession, d: str) -> DataFrame:
    """Transitions between the areas of each recording's Gaussian model, with as many states as its best clusters."""
    areas = grouped.hmm_aois(scanpath(s, d), None).select("recording_id", "k", "aoi")
    return aois.transitions(C.Plan(), "{areas}", "tr").spark(s, areas=areas)


#: Scanpaths as names of grid cells.
_CELLS = C.kin.spatial_bins(C.PATH, "path", "bins", 10, 10, C.WIDTH, C.HEIGHT).then("cells", "SELECT recording_id, k, concat(@letter(gy), @letter(gx)) AS aoi FROM bins")


def _cells(s: SparkSession, d: str) -> DataFrame:
    return _of(_CELLS, "cells", s, d)


#: Corners of those cells by name.
CORNERS = {chr(65 + y) + chr(65 + x): (x * C.WIDTH / 10, y * C.HEIGHT / 10) for x in range(10) for y in range(10)}


def _target_phase(s: SparkSession, d: str) -> DataFrame:
    """Gaze against the target of the pursuit task."""
    both = C.KIN.then("both", "SELECT recording_id, i, x, 250 + 200 * sin(i / 5.0) AS tx FROM kin")
    return grouped.phase_difference(_of(both, "both", s, d), C.FS)


def _panels(s: SparkSession, d: str) -> DataFrame:
    """Whole collapsed sequences in panels of five recordings, so groups stay small however many recordings there are."""
    collapsed = _of(aois.collapse(C.SEQ, "seq", "co"), "co", s, d)
    return grouped.panel_patterns(collapsed.withColumn("panel", F.floor(F.col("recording_id") / 5)), "panel")


def _collapsed(s: SparkSession, d: str) -> DataFrame:
    return _of(aois.collapse(C.SEQ, "seq", "co"), "co", s, d)


def _barycentre(s: SparkSession, d: str) -> DataFrame:
    """The barycentre of all recordings, place by place."""
    mean, rounds = common.barycentre(_collapsed(s, d))
    return s.createDataFrame([(k, x, rounds) for k, x in enumerate(mean)], "place int, aoi string, rounds int")


def _patterns(s: SparkSession, d: str) -> DataFrame:
    """All patterns of up to three AoIs that half of the recordings share."""
    collapsed = _of(aois.collapse(C.SEQ, "seq", "co"), "co", s, d)
    return mining.sequential_patterns(collapsed, longest=3, top=None)


def _learned(kind: str, classifier: str, limits: dict | None = None, net: dict | None = None):
    """Labels of all recordings by a model fitted on every other one; ``training`` marks those."""

    def query(s: SparkSession, d: str) -> DataFrame:
        g = gaze(s, d)
        truth = _of(C.PLANS["ivvt"], "out", s, d).select("recording_id", "i", "label")
        model = learning.fit(g.where("recording_id % 2 = 0"), truth, kind, classifier, net=net, fs=C.FS)
        return learning.predict(g, model, kind, fs=C.FS, limits=limits).withColumn("training", F.expr("recording_id % 2 = 0"))

    return query


def _rounded(spectra: DataFrame) -> DataFrame:
    """Six decimals of the frequency and three of the power, so that sums in another order agree."""
    keep = lambda c, n: (F.floor(F.col(c) * 10**n + 0.5) / 10**n).alias(c)
    return spectra.select("recording_id", "cell", keep("frequency", 6), keep("power", 3))


def _four(df: DataFrame, digits: int = 4) -> DataFrame:
    """Four decimals (or so many) of all doubles; null for NaN."""
    return df.select(*[(F.floor(F.when(~F.isnan(c), F.col(c)) * 10.0**digits + 0.5001) / 10.0**digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _cross(spectra: DataFrame) -> DataFrame:
    """Six decimals of the frequency, one of the spectrum and four of the coherency."""
    digits = {"frequency": 6, "re": 1, "im": 1, "coherency": 4}
    return spectra.select(*[(F.floor(F.col(c) * 10 ** digits[c] + 0.5) / 10 ** digits[c]).alias(c) if c in digits else F.col(c) for c in spectra.columns])


QUERIES = {
    "idit": _labels("idit", **IDIT),
    "idet": _labels("idet", **IDET),
    "ihmm": _labels("ihmm", low=50.0, high=250.0, variance=5000.0),
    "ikf": _labels("ikf", **IKF),
    "imst": _labels("imst", **IMST),
    "i2mc": _labels("i2mc", **I2MC),
    "ivdt": _labels("ivdt", **IVDT),
    "periodogram": lambda s, d: _rounded(grouped.spectra(gaze(s, d), C.FS, None, "boxcar")),
    "welch": lambda s, d: _rounded(grouped.spectra(gaze(s, d), C.FS, 16)),
    "cross_spectra": lambda s, d: _cross(grouped.cross_spectra(gaze(s, d), C.FS, 16)),
    "dfa": lambda s, d: _four(grouped.fluctuation(gaze(s, d), SCALES)),
    "dfa_overlap": lambda s, d: _four(grouped.fluctuation(gaze(s, d), SCALES, overlap=True)),
    "pursuit_task_phase": _target_phase,
    "scanpath_edit_distances": lambda s, d: _four(grouped.sequence_metrics(_cells(s, d), grouped.edit_metrics(CORNERS)), 6),
    "persistence_bars": lambda s, d: grouped.persistence(gaze(s, d), 5.0),
    "sine_phase": lambda s, d: grouped.sine_phase(gaze(s, d), C.FS),
    "scanpath_shapes": lambda s, d: grouped.shapes(scanpath(s, d), C.WIDTH, C.HEIGHT),
    "scanpath_outline": lambda s, d: _four(grouped.shapes(scanpath(s, d), C.WIDTH, C.HEIGHT).select("recording_id", "hull_area", "hull_vertices", "higuchi")),
    "scanpath_similarity": lambda s, d: grouped.pair_metrics(scanpath(s, d), METRICS),
    "aoi_edit_distances": lambda s, d: _four(grouped.sequence_metrics(scanpath(s, d), grouped.edit_metrics(CENTERS)), 6),
    "aoi_hmm": lambda s, d: grouped.hmm_aois(scanpath(s, d)),
    "aoi_hmm_transitions": _hmm_transitions,
    "aoi_hmm_transition_entropy": lambda s, d: grouped.entropies(_hmm_transitions(s, d)),
    "aoi_joint_kmeans": lambda s, d: learning.joint_areas(scanpath(s, d)),
    "aoi_alignments": lambda s, d: grouped.alignments(scanpath(s, d)),
    "aoi_local_alignments": lambda s, d: grouped.alignments(scanpath(s, d), align=K.local_alignment),
    "scanpath_dtw_links": lambda s, d: grouped.warp_links(scanpath(s, d)),
    "scanpath_frechet_links": lambda s, d: grouped.warp_links(scanpath(s, d), "frechet"),
    "aoi_transition_entropy": _entropies,
    "aoi_common_patterns": _panels,
    "aoi_lempel_ziv": lambda s, d: grouped.lempel_ziv(scanpath(s, d)),
    "learn_forest": _learned("fc", "rf"),
    "learn_perceptron": _learned("fc", "mlp"),
    "learn_machines": _learned("fc", "svm"),
    "learn_neighbours": _learned("fc", "knn"),
    "learn_directions": _learned("hov", "rf"),
    "learn_features_filtered": _learned("ifc", "rf", THREE),
    "learn_kernel_machines": _learned("fc", "rbf"),
    "learn_convnet": _learned("fc", "cnn", net={"window": 33, "channels": (12, 16), "kernels": (6, 4), "hidden": 32, "epochs": 10, "batch": 2048, "rate": 3e-3}),
    "ifc_features": lambda s, d: _four(grouped.ifc_features(gaze(s, d), C.FS, i2mc=False)),
    "ifc_features_i2mc": lambda s, d: _four(grouped.ifc_features(gaze(s, d), C.FS).select("recording_id", "i", "i2mc")),
    "aoi_frequent_patterns": _patterns,
} | {f"aoi_{m}": (lambda s, d, m=m: grouped.clusters(scanpath(s, d), m, DIAGONAL)) for m in ("kmeans", "dbscan", "dbscan_all", "density_peaks", "mean_shift", "mean_shift_near", "affinity")}


def _points(s: SparkSession, d: str) -> DataFrame:
    return pairwise.pack_points(scanpath(s, d))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    bins = C.kin.spatial_bins(C.PATH, "path", "bins", 8, 8, C.WIDTH, C.HEIGHT)
    return pairwise.pack_symbols(_of(bins.then("sym", "SELECT recording_id, k, concat(@letter(gy), @letter(gx)) AS aoi FROM bins"), "sym", s, d))


#: All pairs block by block; the catalogue's joins of the same names check them in SQL.
QUERIES |= {
    "cross_recurrence": lambda s, d: pairwise.compare(_points(s, d), pairwise.cross_recurrence(C.RADIUS), pairwise.CROSS_RECURRENCE),
    "eye_analysis_distance": lambda s, d: pairwise.compare(_points(s, d), pairwise.PointMapping(), pairwise.POINT_MAPPING),
    "time_delay_embedding": lambda s, d: pairwise.compare(_points(s, d), pairwise.time_delay_embedding(), pairwise.TIME_DELAY),
    "subsmatch_similarity": lambda s, d: pairwise.compare(_symbols(s, d), pairwise.SubsequenceSimilarity(), pairwise.SUBSEQUENCES),
    "pair_bins": lambda s, d: pairwise.compare(_points(s, d), pairwise.joint_bins(8, 8), pairwise.JOINT_BINS),
    "aoi_common_subsequence": lambda s, d: common.common_subsequence(_collapsed(s, d)).withColumn("pattern", F.array_join("pattern", ",")),
    "aoi_barycentre": _barycentre,
    "aoi_likeness_tree": lambda s, d: common.likeness_tree(_collapsed(s, d)),
    "recurrence": lambda s, d: grouped.recurrence(scanpath(s, d), C.RADIUS),
    "pursuit_task_entropy": lambda s, d: grouped.approximate_entropy(_of(C.KIN.then("err", "SELECT recording_id, i, vx - 40 * cos(i / 5.0) AS e FROM kin"), "err", s, d), 2, 150.0),
    "persistence_curves_of_bars": lambda s, d: signals.persistence_curves(C.Plan(), "{bars}", "out", 0.0, 500.0).spark(s, bars=grouped.persistence(gaze(s, d), 5.0)),
    "persistence_landscapes_of_bars": lambda s, d: signals.persistence_landscapes(C.Plan(), "{bars}", "out", 0.0, 500.0).spark(s, bars=grouped.persistence(gaze(s, d), 5.0)),
    "cross_spectrum_one_segment": lambda s, d: _cross(grouped.cross_spectra(gaze(s, d), C.FS, None).drop("coherency")),
    "aoi_sequences_from_gaze": lambda s, d: registry.sequences(gaze(s, d), fs=C.FS, threshold=C.SLOW, limits={"min_fix": 1.0, "max_fix": 1000.0, "min_sac": 0.0}),
    "aoi_by_name": lambda s, d: _four(registry.areas(scanpath(s, d), "I_DT", DIAGONAL, fewest=4).select("recording_id", "k", "aoi", "cx", "cy")),
    "scanpath_near_pairs": lambda s, d: pairwise.compare(_points(s, d), pairwise.near_pairs(100.0), pairwise.NEAR),
}


def _gamma(s: SparkSession, d: str) -> DataFrame:
    """A row a saccade: the shape of a gamma distribution with a free start over its speeds, its last sample left out; null below three."""
    import pandas as pd

    sac = _of(C._saccades(C.KIN), "sac0_s", s, d).where("i < b OR a = b").select("recording_id", "i", "a", "b", "speed")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(a), int(h.b.iloc[0]), K.gamma_shape_shifted(h.speed.to_numpy(float)[: max(0, int(h.b.iloc[0]) - int(a))])) for a, h in g.groupby("a")]
        return pd.DataFrame(rows, columns=["a", "b", "gamma_skewness"])

    return grouped.per_recording(sac, run, "a long, b long, gamma_skewness double", ["a", "b", "speed"])


QUERIES["saccade_gamma_skewness"] = _gamma


def _borji(s: SparkSession, d: str) -> DataFrame:
    """AUC of fixations on the saliency map of all recordings against seeded random cells, per recording."""
    import pandas as pd

    cells = scanpath(s, d).select("recording_id", "k", F.least(F.lit(24), F.floor(F.col("x") / (C.WIDTH / 25))).cast("int").alias("gx"), F.least(F.lit(24), F.floor(F.col("y") / (C.HEIGHT / 25))).cast("int").alias("gy"))
    # the map has 625 cells whatever the input
    grid = np.zeros((25, 25))
    for r in C.PLANS["saliency_count"].spark(s, events=s.read.parquet(f"{d}/events.parquet")).collect():
        grid[r["gy"], r["gx"]] = r["v"]

    # cells by their saliency: how many hits lie above and at a drawn cell's value is a look-up
    values, level = np.unique(grid.ravel(), return_inverse=True)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = len(g)
        rng = np.random.default_rng(int(g.recording_id.iloc[0]))
        at = np.bincount(level[g.gy.to_numpy() * 25 + g.gx.to_numpy()], minlength=len(values))
        above = n - np.cumsum(at)
        drawn = level[rng.choice(len(level), (100, n))]
        wins = above[drawn].sum(1) / n**2 + 0.5 * (at[drawn].sum(1) / n**2)
        return pd.DataFrame({"auc_borji": [float(np.mean(wins))]})

    return grouped.per_recording(cells, run, "auc_borji double", ["gx", "gy"], "k")


QUERIES["saliency_auc_borji"] = _borji


def _oracle(plan) -> str:
    """A plan in DuckDB's dialect that may have recursive relations."""
    return plan.duckdb().replace("WITH ", "WITH RECURSIVE ", 1)


def _idet_sql() -> str:
    """I-DeT without a scan: how far a sample's neighbourhood reaches on either side is a chain of conditions on the next samples."""
    def reach(f: str) -> str:
        close = [f"coalesce(sqrt(power({f}(x, {j}) OVER ({C.kin.W}) - x, 2) + power({f}(y, {j}) OVER ({C.kin.W}) - y, 2)) <= {IDET['eps']}, false)" for j in range(1, IDET["window"] + 1)]
        return "CASE " + " ".join(f"WHEN NOT {c} THEN {k}" for k, c in enumerate(close)) + f" ELSE {IDET['window']} END"

    p = C.KIN.then("around", f"SELECT recording_id, i, status, {reach('lag')} AS back, {reach('lead')} AS ahead FROM kin")
    p = p.then("raw", f"SELECT s.recording_id, s.i, max(s.status) AS status, max(CASE WHEN c.back + c.ahead + 1 >= {IDET['min_points']} THEN 1 ELSE 0 END) AS scan FROM around s JOIN around c ON s.recording_id = c.recording_id AND s.i BETWEEN c.i - c.back AND c.i + c.ahead GROUP BY s.recording_id, s.i")
    return _oracle(_two_classes(p))


def _two_classes(p):
    """Labels of two classes after ``raw`` (recording_id, i, status, scan)."""
    return grouped.two_class(p, "raw", "lab", "scan = 1", C.FS, **TWO).then("out", "SELECT recording_id, i, label FROM lab")


def _ikf_sql() -> str:
    """I-KF as a recursion over samples: covariance, then both axes' positions and speeds."""
    q, r, dt, w = IKF["sigma_1"] ** 2, IKF["sigma_2"] ** 2, IKF["dt"], IKF["window"]
    p = C.KIN.then(
        "filt",
        f"""SELECT recording_id, i, x AS px, vx AS sx, y AS py, vy AS sy, vx AS ox, vy AS oy, 0e0 AS p0, 0e0 AS p1, 0e0 AS p2, 0e0 AS p3 FROM kin WHERE i = 0
        UNION ALL SELECT recording_id, i, px + {dt} * sx + g * (x - px - {dt} * sx), sx + h * (x - px - {dt} * sx), py + {dt} * sy + g * (y - py - {dt} * sy), sy + h * (y - py - {dt} * sy), sx, sy, (1 - g) * q0, q1, (1 - h) * q2, q3
        FROM (SELECT *, q0 / (q0 + {r}) AS g, q2 / (q0 + {r}) AS h FROM (SELECT k.recording_id, k.i, k.x, k.y, f.px, f.sx, f.py, f.sy, f.p0 + {dt} * (f.p1 + f.p2) + {dt * dt} * f.p3 + {q} AS q0, f.p1 + {dt} * f.p3 AS q1, f.p2 + {dt} * f.p3 AS q2, f.p3 + {q} AS q3 FROM filt f JOIN kin k ON f.recording_id = k.recording_id AND k.i = f.i + 1) a) b""",
    )
    p = p.then("off", "SELECT k.recording_id, k.i, k.status, power(sqrt(f.ox * f.ox + f.oy * f.oy) - sqrt(k.vx * k.vx + k.vy * k.vy), 2) AS e, count(*) OVER (PARTITION BY k.recording_id) AS n FROM kin k JOIN filt f ON k.recording_id = f.recording_id AND k.i = f.i")
    p = p.then("chi", f"SELECT *, CASE WHEN (floor(i / {w}) + 1) * {w} < n THEN sum(e) OVER (PARTITION BY recording_id, floor(i / {w})) / 5 ELSE 0 END AS c FROM off")
    low = f"c <= {IKF['limit']}"
    p = p.then("raw", f"SELECT recording_id, i, status, CASE WHEN ({low} AND i < n - 1) OR coalesce(lag({low}) OVER ({C.kin.W}), false) THEN 1 ELSE 0 END AS scan FROM chi")
    return _oracle(_two_classes(p))


#: Coordinates of each recording as lists, for recursions that look at ranges; and a range's dispersion.
_LISTS = C.KIN.then("lists", "SELECT recording_id, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys, count(*) AS n FROM kin GROUP BY recording_id")
_RANGE = "list_max(xs[s + 1:e]) - list_min(xs[s + 1:e]) + list_max(ys[s + 1:e]) - list_min(ys[s + 1:e])"


def _idit_sql() -> str:
    """I-DiT as a recursion over windows [s, e): 0 tries a window, 1 grows one."""
    w, limit = IDIT["window"], IDIT["limit"]
    p = _LISTS.then(
        "walk",
        f"""SELECT recording_id, CAST(0 AS BIGINT) AS s, least({w}, n) AS e, 0 AS phase FROM lists
        UNION ALL SELECT recording_id, CASE WHEN phase = 0 AND NOT ok THEN s + 1 WHEN phase = 1 AND NOT grow THEN e ELSE s END,
        CASE WHEN phase = 0 AND NOT ok THEN least(s + 1 + {w}, n) WHEN phase = 0 THEN e WHEN grow THEN e + 1 ELSE least(e + {w}, n) END, CASE WHEN phase = 0 AND ok OR phase = 1 AND grow THEN 1 ELSE 0 END
        FROM (SELECT v.recording_id, s, e, phase, n, {_RANGE} < {limit} AS ok, e < n - 1 AND {_RANGE} < {limit} AS grow FROM walk v JOIN lists l ON v.recording_id = l.recording_id WHERE e - s >= 2) q""",
    )
    p = p.then("held", "SELECT recording_id, s, max(e) AS e FROM walk WHERE phase = 1 GROUP BY recording_id, s")
    p = p.then("raw", "SELECT k.recording_id, k.i, k.status, CASE WHEN h.s IS NULL THEN 0 ELSE 1 END AS scan FROM kin k LEFT JOIN held h ON k.recording_id = h.recording_id AND k.i >= h.s AND k.i < h.e")
    return _oracle(_two_classes(p))


def _ivdt_sql() -> str:
    """I-VDT as the same recursion inside the slow runs."""
    w, limit, fast = IVDT["window"], IVDT["limit"], IVDT["fast"]
    p = C.islands.runs(_LISTS, "kin", "slow", f"speed <= {fast}", w)
    p = p.then(
        "walk",
        f"""SELECT recording_id, b + 1 AS past, a AS s, a + {w} AS e, 0 AS phase FROM slow
        UNION ALL SELECT recording_id, past, CASE WHEN phase = 0 AND NOT ok THEN s + 1 WHEN phase = 1 AND NOT grow THEN e ELSE s END,
        CASE WHEN phase = 0 AND NOT ok THEN s + 1 + {w} WHEN phase = 0 THEN e WHEN grow THEN e + 1 ELSE e + {w} END, CASE WHEN phase = 0 AND ok OR phase = 1 AND grow THEN 1 ELSE 0 END
        FROM (SELECT v.recording_id, past, s, e, phase, {_RANGE} < {limit} AS ok, e < past AND {_RANGE} < {limit} AS grow FROM walk v JOIN lists l ON v.recording_id = l.recording_id WHERE phase = 1 OR s + {w} <= past) q""",
    )
    p = p.then("held", "SELECT recording_id, s, max(e) AS e FROM walk WHERE phase = 1 GROUP BY recording_id, s")
    p = p.then("scanned", f"SELECT k.recording_id, k.i, k.status, CASE WHEN k.speed > {fast} THEN 2 WHEN h.s IS NULL THEN 3 WHEN k.i = h.e - 1 THEN 0 ELSE 1 END AS label FROM kin k LEFT JOIN held h ON k.recording_id = h.recording_id AND k.i >= h.s AND k.i < h.e")
    return _oracle(grouped.three_class(p, "scanned", "lab", C.FS, **THREE).then("out", "SELECT recording_id, i, label FROM lab"))


def _lempel_ziv_sql() -> str:
    """Phrases of a recording as a recursion over its symbols."""
    p = C.PATH.then("seqs", "SELECT recording_id, list(aoi ORDER BY k) AS s, count(*) AS n FROM path GROUP BY recording_id")
    p = p.then(
        "lz",
        """SELECT recording_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, '' AS phrase FROM seqs
        UNION ALL SELECT recording_id, k + 1, CASE WHEN list_contains(seen, next) THEN seen ELSE list_append(seen, next) END, CASE WHEN list_contains(seen, next) THEN next ELSE '' END
        FROM (SELECT z.recording_id, z.k, z.seen, concat(z.phrase, q.s[z.k + 1]) AS next FROM lz z JOIN seqs q ON z.recording_id = q.recording_id WHERE z.k < q.n) t""",
    )
    return _oracle(p.then("out", "SELECT z.recording_id, CAST(len(z.seen) + CASE WHEN z.phrase = '' THEN 0 ELSE 1 END AS BIGINT) AS complexity FROM lz z JOIN seqs q ON z.recording_id = q.recording_id AND z.k = q.n"))


def _patterns_sql() -> str:
    """Patterns of up to three symbols, gaps allowed, by joins of places."""
    co = aois.collapse(C.SEQ, "seq", "co")
    parts = []
    for n in (1, 2, 3):
        names = [f"s{j}" for j in range(n)]
        joins = "co s0" + "".join(f" JOIN co s{j} ON s{j}.recording_id = s0.recording_id AND s{j}.k > s{j - 1}.k" for j in range(1, n))
        symbols = ", ".join(f"{x}.aoi" for x in names)
        parts.append(f"SELECT concat_ws(',', {symbols}) AS pattern, CAST({n} AS INT) AS len, count(DISTINCT s0.recording_id) AS support FROM {joins} GROUP BY {symbols}")
    p = co.then("found", " UNION ALL ".join(parts)).then("total", "SELECT count(DISTINCT recording_id) AS n FROM co")
    return p.then("out", "SELECT pattern, len, support, support / CAST(n AS DOUBLE) AS share FROM found CROSS JOIN total WHERE support >= ceil(0.5 * n)").duckdb()


def _spectrum_sql(segment: int | None) -> str:
    """Spectral density as plain sums over cosines and sines: one segment without a taper, or half-overlapping ones with a Hann taper."""
    size = f"least({segment}, n)" if segment else "n"
    taper = "0.5 - 0.5 * cos(2 * pi() * j / m)" if segment else "1e0"
    p = C.KIN.then("sized", f"SELECT recording_id, i, x, n, CAST({size} AS BIGINT) AS m FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM kin) q")
    p = p.then("starts", "SELECT recording_id, m, unnest(range(0, n - m + 1, CASE WHEN m = n THEN m ELSE m - m // 2 END)) AS a FROM (SELECT DISTINCT recording_id, n, m FROM sized) q")
    p = p.then("cut", "SELECT t.recording_id, t.a, t.m, z.i - t.a AS j, z.x - avg(z.x) OVER (PARTITION BY t.recording_id, t.a) AS v FROM starts t JOIN sized z ON t.recording_id = z.recording_id AND z.i >= t.a AND z.i < t.a + t.m")
    p = p.then("tapered", f"SELECT recording_id, a, m, j, v * ({taper}) AS v, power({taper}, 2) AS t2 FROM cut")
    p = p.then("cells", "SELECT recording_id, a, m, cell, sum(v * cos(2 * pi() * cell * j / m)) AS re, sum(v * sin(2 * pi() * cell * j / m)) AS im, sum(t2) AS t2 FROM (SELECT *, unnest(range(0, m // 2 + 1)) AS cell FROM tapered) q GROUP BY recording_id, a, m, cell")
    p = p.then("means", f"SELECT recording_id, m, cell, avg((re * re + im * im) / ({C.FS} * t2)) * CASE WHEN cell = 0 OR cell * 2 = m THEN 1 ELSE 2 END AS power FROM cells GROUP BY recording_id, m, cell")
    return p.then("out", f"SELECT recording_id, CAST(cell AS BIGINT) AS cell, floor(cell * {C.FS} / m * 1e6 + 0.5) / 1e6 AS frequency, floor(power * 1e3 + 0.5) / 1e3 AS power FROM means").duckdb()


def _ifc_sql() -> str:
    """Features of I-FC by joins of each sample with its frame, the first or last sample beyond the ends; frames of one sample to each side."""
    w = C.kin.W
    step = lambda c: f"coalesce(lead({c}) OVER ({w}) - {c}, {c} - lag({c}) OVER ({w}), 0)"
    dot = "ux * {0}(ux) OVER ({1}) + uy * {0}(uy) OVER ({1}) + uz * {0}(uz) OVER ({1})"
    angle = lambda f: f"CASE WHEN {f}(ux) OVER ({w}) IS NOT NULL THEN degrees(acos(greatest(-1.0, least(1.0, {dot.format(f, w)})))) END"
    p = C.KIN.then("base", f"SELECT recording_id, i, theta_x, theta_y, ux, uy, uz, speed_angular AS v, {step('speed_angular')} AS acc, atan2({step('y')} + 1e-12, {step('x')} + 1e-12) AS turn, coalesce({angle('lead')}, {angle('lag')}, 0) AS far, max(i) OVER (PARTITION BY recording_id) AS top FROM kin")
    p = p.then("offsets", "SELECT unnest([-1, 0, 1]) AS o")
    p = p.then("frames", "SELECT b.recording_id, b.i, n.theta_x AS tx, n.theta_y AS ty, n.ux, n.uy, n.uz, n.far, n.turn FROM base b CROSS JOIN offsets JOIN base n ON n.recording_id = b.recording_id AND n.i = least(greatest(b.i + o, 0), b.top)")
    p = p.then("f0", "SELECT recording_id, i, avg(tx) AS mx, avg(ty) AS my FROM frames GROUP BY recording_id, i")
    p = p.then("corr_", "SELECT f.recording_id, f.i, sum((tx - mx) * (ty - my)) / nullif(sqrt(sum(power(tx - mx, 2)) * sum(power(ty - my, 2))), 0) AS r, sqrt(avg(power(tx - mx, 2))) AS std_x, sqrt(avg(power(ty - my, 2))) AS std_y FROM frames f JOIN f0 ON f0.recording_id = f.recording_id AND f0.i = f.i GROUP BY f.recording_id, f.i")
    p = p.then("f1", "SELECT recording_id, i, max(tx) - min(tx) + max(ty) - min(ty) AS dispersion, sqrt(avg(far * far)) AS rms, (power(avg(cos(turn)), 2) + power(avg(sin(turn)), 2)) * 3 AS z_ray, avg(ux) AS ax, avg(uy) AS ay, avg(uz) AS az, median(ux) AS bx, median(uy) AS by_, median(uz) AS bz FROM frames GROUP BY recording_id, i")
    p = p.then("f2", f"SELECT f1.*, std_x, std_y, {float(-2 * np.pi * np.log(1 - 0.68))!r} * std_x * std_y * sqrt(CASE WHEN 1 - coalesce(r * r, 0) < 1e-9 THEN 0 ELSE 1 - coalesce(r * r, 0) END) AS bcea FROM f1 JOIN corr_ c ON c.recording_id = f1.recording_id AND c.i = f1.i")
    apart = lambda c: f"degrees(acos(greatest(-1.0, least(1.0, (n.{c[0]} * p.{c[0]} + n.{c[1]} * p.{c[1]} + n.{c[2]} * p.{c[2]}) / (sqrt(power(n.{c[0]}, 2) + power(n.{c[1]}, 2) + power(n.{c[2]}, 2)) * sqrt(power(p.{c[0]}, 2) + power(p.{c[1]}, 2) + power(p.{c[2]}, 2)))))))"
    columns = {"acceleration": "b.acc", "bcea": "f.bcea", "delta_bcea": "n.bcea - p.bcea", "delta_rms": "n.rms - p.rms", "delta_std_x": "n.std_x - p.std_x", "delta_std_y": "n.std_y - p.std_y", "dispersion": "f.dispersion", "mean_dist": apart(("ax", "ay", "az")), "med_dist": apart(("bx", "by_", "bz")), "rms": "f.rms", "sf": repr(C.FS), "std_x": "f.std_x", "std_y": "f.std_y", "velocity": "b.v", "z_ray": "f.z_ray"}
    wanted = ", ".join(f"floor(({x}) * 1e4 + 0.5001) / 1e4 AS {k}" for k, x in columns.items())
    return p.then("out", f"SELECT b.recording_id, b.i, {wanted} FROM base b JOIN f2 f ON f.recording_id = b.recording_id AND f.i = b.i JOIN f2 n ON n.recording_id = b.recording_id AND n.i = least(b.i + 1, b.top) JOIN f2 p ON p.recording_id = b.recording_id AND p.i = greatest(b.i - 1, 0)").duckdb()


def _bars_plan():
    """Bars without a union of components: a sample's component dies at the lower of the barriers to the nearest lower samples on either side."""
    p = C.KIN.then("lower", "SELECT s.recording_id, s.i, s.x, (SELECT max(t.i) FROM kin t WHERE t.recording_id = s.recording_id AND t.i < s.i AND t.x <= s.x) AS l, (SELECT min(t.i) FROM kin t WHERE t.recording_id = s.recording_id AND t.i > s.i AND t.x < s.x) AS r FROM kin s")
    p = p.then("walls", "SELECT recording_id, i, x, l, r, (SELECT max(t.x) FROM kin t WHERE t.recording_id = w.recording_id AND t.i BETWEEN w.l AND w.i) AS lw, (SELECT max(t.x) FROM kin t WHERE t.recording_id = w.recording_id AND t.i BETWEEN w.i AND w.r) AS rw FROM lower w")
    p = p.then("dead", "SELECT recording_id, x AS birth, CASE WHEN l IS NULL THEN rw WHEN r IS NULL THEN lw ELSE least(lw, rw) END AS death FROM walls WHERE l IS NOT NULL OR r IS NOT NULL")
    return p.then("bars", "SELECT recording_id, birth, death FROM dead WHERE death > birth AND death - birth >= 5.0 UNION ALL SELECT recording_id, min(x) AS birth, max(x) AS death FROM kin GROUP BY recording_id HAVING max(x) - min(x) >= 5.0")


#: Checks of kernels by other means in SQL.
ORACLE_SQL = {"persistence_bars": _bars_plan().then("out", "SELECT recording_id, birth, death FROM bars").duckdb(), "persistence_curves_of_bars": signals.persistence_curves(_bars_plan(), "bars", "out", 0.0, 500.0).duckdb(), "persistence_landscapes_of_bars": signals.persistence_landscapes(_bars_plan(), "bars", "out", 0.0, 500.0).duckdb(), "ifc_features": _ifc_sql(), "idet": _idet_sql(), "ikf": _ikf_sql(), "idit": _idit_sql(), "ivdt": _ivdt_sql(), "aoi_lempel_ziv": _lempel_ziv_sql(), "aoi_frequent_patterns": _patterns_sql(), "periodogram": _spectrum_sql(None), "welch": _spectrum_sql(16)}
ORACLE_SQL |= {
    "aoi_edit_distances": checks.edit_measures(C.PATH.then("syms", "SELECT recording_id, k, aoi FROM path"), CENTERS),
    "scanpath_edit_distances": checks.edit_measures(_CELLS.then("syms", "SELECT recording_id, k, aoi FROM cells"), CORNERS),
    "scanpath_outline": checks.outline(C.WIDTH, C.HEIGHT),
    "i2mc": checks.two_means(TWO, **I2MC),
    # frames of 0.2 s have one sample to each side at this rate, steps of 0.02 s are single samples
    "ifc_features_i2mc": checks.two_means_feature(3, 1),
    "aoi_transition_entropy": checks.entropies(aois.transitions(C.SEQ, "seq", "tr")),
    "imst": checks.spanning_tree(TWO, **IMST),
    "dfa": checks.fluctuation(SCALES, False),
    "dfa_overlap": checks.fluctuation(SCALES, True),
    "cross_spectra": checks.cross_spectra(16),
    "cross_spectrum_one_segment": checks.cross_spectra(None),
    "aoi_dbscan": checks.density(0.05 * DIAGONAL),
    "aoi_dbscan_all": checks.density(0.05 * DIAGONAL, noise_too=True),
    "aoi_by_name": checks.merged_areas(0.05 * DIAGONAL, 5, 4),
    "aoi_density_peaks": checks.peaks(0.1 * DIAGONAL),
}
