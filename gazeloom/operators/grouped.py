"""Kernels inside Spark: one recording per group, pairs by blocks, one panel of recordings per group.

Only the columns that a kernel reads are shuffled. Recordings come sorted, and a task
takes many short ones at once. A recording fits a worker; a panel is a bounded number
of recordings chosen by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.relational import Plan
from . import batches, pairwise
from . import kernels as K
from .islands import two_class
from .segmentation import three_class


#: Samples that a task takes at a time, and besides as many as the last recording has.
BATCH_ROWS = 20_000
#: Lengths of scanpaths whose pairs are looked up in one table.
LENGTHS = 512


def per_batch(df: DataFrame, fn: Callable[[pd.DataFrame, np.ndarray], tuple[dict, np.ndarray]], schema: str, columns: list[str], order: str = "i", key: str = "recording_id", rows: int = BATCH_ROWS) -> DataFrame:
    """Apply ``fn`` to whole recordings in order, as many at once as have about ``rows`` samples.

    ``fn`` gets their samples one recording after the other and the bounds of each; it
    returns the schema's columns by name without the key, which comes first, and each
    row's recording as a number.
    """
    names = [key, order, *[c for c in columns if c not in (key, order)]]
    whole = f"{key} long, {schema}"
    arrow = pairwise._arrow_schema(T._parse_datatype_string(whole))

    def made(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        out, number = fn(table.to_pandas(), bounds)
        ids = table.column(0).combine_chunks().take(pa.array(bounds[:-1][number]))
        found = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type, from_pandas=True) for f in list(arrow)[1:]]
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *found], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= rows and held[0].column(0)[0].as_py() != b.column(0)[-1].as_py():
                table = pa.Table.from_batches(held)
                bounds = _bounds(table.column(0))
                yield made(table.slice(0, bounds[-2]), bounds[:-1])
                held = table.slice(bounds[-2]).to_batches()
                n = sum(h.num_rows for h in held)
        if held:
            table = pa.Table.from_batches(held)
            yield made(table, _bounds(table.column(0)))

    return df.select(*names).repartition(key).sortWithinPartitions(key, order).mapInArrow(run, whole)


def _bounds(ids: pa.ChunkedArray) -> np.ndarray:
    """Where each recording starts, and the end; ids come sorted, null counts as one."""
    value, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()
    return np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1, [len(value)]])


def per_recording(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str], order: str = "i", key: str = "recording_id") -> DataFrame:
    """Apply ``fn`` to each recording in order; ``fn`` returns the schema's columns without the key, which comes first."""

    def run(g: pd.DataFrame, bounds: np.ndarray) -> tuple[dict, np.ndarray]:
        found = [fn(g.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds, bounds[1:], strict=False)]
        out = pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]
        return {c: out[c] for c in out.columns}, np.repeat(np.arange(len(found)), [len(f) for f in found])

    return per_batch(df, run, schema, columns, order, key)


def labels(df: DataFrame, method: str, **p) -> DataFrame:
    """(recording_id, i, status, label) by a scan method over (i, x, y, status, speed, vx, vy), before post-processing: idit, idet, ihmm, ikf, imst, i2mc (1 fixation, 0 other), ivdt (1, 2, 3)."""
    methods = {
        "idit": lambda g: K.dispersion_windows(g.x.to_numpy(), g.y.to_numpy(), p["window"], p["limit"]),
        "idet": lambda g: K.density_runs(g.x.to_numpy(), g.y.to_numpy(), p["eps"], p["window"], p["min_points"]),
        "ihmm": lambda g: K.gaussian_hmm_1d(g.speed.to_numpy(), p["low"], p["high"], p["variance"], p.get("rounds", 10)),
        "ikf": lambda g: K.kalman_windows(g.x.to_numpy(), g.y.to_numpy(), g.vx.to_numpy(), g.vy.to_numpy(), p["dt"], p["sigma_1"], p["sigma_2"], p["window"], p["limit"]),
        "imst": lambda g: K.spanning_tree_votes(g.x.to_numpy(), g.y.to_numpy(), p["window"], p["eps"], p["min_points"]),
        "i2mc": lambda g: K.two_means_fixations(g.x.to_numpy(), g.y.to_numpy(), p["window"], p["step"], p.get("shortest", 0), p.get("distance", 0.0)),
        "ivdt": lambda g: K.velocity_dispersion(g.x.to_numpy(), g.y.to_numpy(), g.speed.to_numpy(), p["fast"], p["window"], p["limit"]),
    }
    fn = methods[method]
    run = lambda g: pd.DataFrame({"i": g.i, "status": g.status, "label": fn(g)})
    if method == "ivdt":
        return by_parts(df, run, F.col("speed") > p["fast"])
    if method == "i2mc":

        def at_once(g: pd.DataFrame, bounds: np.ndarray) -> tuple[dict, np.ndarray]:
            label = K.two_means_fixations(g.x.to_numpy(float), g.y.to_numpy(float), p["window"], p["step"], p.get("shortest", 0), p.get("distance", 0.0), bounds)
            return {"i": g.i, "status": g.status, "label": label}, K.numbers(bounds)

        return per_batch(df, at_once, "i long, status double, label int", ["x", "y", "status"])
    return per_recording(df, run, "i long, status double, label int", ["x", "y", "status", "speed", "vx", "vy"])


def by_parts(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], known: Column, most: int = 10_000) -> DataFrame:
    """(recording_id, i, status, label) of a scan whose state is known at samples where ``known`` holds: a recording is cut behind such samples, so a long one fills many tasks.

    Parts are as long as it takes to hold ``most`` samples and end at a known one; the cut changes no label.
    """
    order = Window.partitionBy("recording_id").orderBy("i")
    # the block that the last known sample before this one lies in: it changes only behind a known sample
    last = F.max(F.when(known, F.floor(F.col("i") / most))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = df.select("recording_id", "i", "x", "y", "status", "speed", F.coalesce(last, F.lit(-1)).alias("part"))
    schema = "recording_id long, i long, status double, label int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("i", kind="stable").reset_index(drop=True)
        out = fn(g)
        out.insert(0, "recording_id", g.recording_id)
        return out

    return parted.groupBy("recording_id", "part").applyInPandas(run, schema)


def segment(df: DataFrame, method: str, fs: float, limits: dict, **p) -> DataFrame:
    """(recording_id, i, label): a scan method with its post-processing, that of two classes (1 fixation, 2 saccade, 0 none) or for ivdt of three."""
    raw = Plan().then("raw", "SELECT recording_id, i, status, label AS scan FROM {raw}")
    if method == "ivdt":
        done = three_class(raw.then("scanned", "SELECT recording_id, i, status, scan AS label FROM raw"), "scanned", "lab", fs, **limits)
    else:
        done = two_class(raw, "raw", "lab", "scan = 1", fs, **limits)
    return done.then("out", "SELECT recording_id, i, label FROM lab").spark(df.sparkSession, raw=labels(df, method, **p))


def spectra(df: DataFrame, fs: float, segment: int | None = None, window: str = "hann", column: str = "x") -> DataFrame:
    """(recording_id, cell, frequency, power): one segment with a boxcar is the periodogram, shorter segments Welch's estimate."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g[column].to_numpy(float)
        f, p = K.spectral_density(v, v, fs, segment, window)
        return pd.DataFrame({"cell": range(len(f)), "frequency": f, "power": p.real})

    return per_recording(df, run, "cell long, frequency double, power double", [column])


def cross_spectra(df: DataFrame, fs: float, segment: int | None, column: str = "x", pairs: DataFrame | None = None) -> DataFrame:
    """(id_1, id_2, cell, frequency, re, im, coherency) for all pairs of recordings, or those given; without a segment length one tapered segment of each pair's longer length (coherency null)."""

    return pairwise.between(pairwise.pack_points(df, (column,), "i"), pairs, batches.CrossSpectra(fs, segment), "id_1 long, id_2 long, cell long, frequency double, re double, im double, coherency double")


def pair_metrics(scanpaths: DataFrame, metrics: dict[str, Callable[[np.ndarray, np.ndarray], float | dict]], pairs: DataFrame | None = None) -> DataFrame:
    """(id_1, id_2, metric, value) for all pairs of scanpaths, or those given; a metric may return several named values."""
    packed, schema = pairwise.pack_points(scanpaths, ("x", "y", "dur")), "id_1 long, id_2 long, metric string, value double"
    if isinstance(metrics, PathMetrics):
        chances = _chances(packed, metrics) if pairs is None else None
        return pairwise.between(packed, pairs, batches.PathMeasures(**metrics.parameters, chances=chances), schema)

    def kernel(one, v, ids, vs):
        s = np.asarray(v, float).reshape(-1, 3)
        for two, w in zip(ids.tolist(), vs, strict=True):
            t = np.asarray(w, float).reshape(-1, 3)
            for name, fn in metrics.items():
                got = fn(s, t)
                for k, x in got.items() if isinstance(got, dict) else [(None, got)]:
                    yield one, two, name if k is None else f"{name}_{k}", float(x)

    return pairwise.between(packed, pairs, kernel, schema)


class PathMetrics(dict):
    """Measures by name, and the parameters that they share."""

    parameters: dict[str, float]


def path_metrics(width: float, height: float, diagonal: float, step: float = 0.25, rounds: int = 1000) -> dict[str, Callable[[np.ndarray, np.ndarray], float | dict]]:
    """Dynamic time warping, discrete Frechet, MultiMatch, ScanMatch (``step`` seconds a symbol) and Mannan's measure (``rounds`` random scanpaths)."""
    found = PathMetrics({
        "dtw": K.dtw,
        "frechet": K.discrete_frechet,
        "multimatch": lambda s, t: K.multimatch(s, t, diagonal),
        "scanmatch": lambda s, t: K.scanmatch(s, t, width, height, step=step),
        "mannan": lambda s, t: K.mannan(s, t, width, height, rounds),
    })
    found.parameters = {"width": width, "height": height, "diagonal": diagonal, "step": step, "rounds": rounds}
    return found


def _chances(packed: DataFrame, metrics: PathMetrics) -> dict[tuple[int, int], float]:
    """Mannan's distances of random scanpaths for all pairs of lengths that occur, each made once; with more than ``LENGTHS`` lengths tasks make those they meet."""
    lengths = packed.groupBy((F.size("v") / 3).cast("int").alias("n")).agg(F.min("recording_id").alias("low"), F.max("recording_id").alias("high"))
    found = [tuple(r) for r in lengths.limit(LENGTHS + 1).collect()]
    if len(found) > LENGTHS:
        return {}
    width, height, rounds = (metrics.parameters[k] for k in ("width", "height", "rounds"))
    # a length comes first where a smaller id has it
    met = [(n, m) for n, low, _ in found for m, _, high in found if low < high]
    spark = packed.sparkSession
    rows = spark.createDataFrame(met, "n int, m int").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            yield b.assign(chance=[K.mannan_chance(n, m, width, height, rounds, 0) for n, m in zip(b.n.tolist(), b.m.tolist(), strict=True)])

    return {(r["n"], r["m"]): r["chance"] for r in rows.mapInPandas(run, "n int, m int, chance double").collect()}


def sequence_metrics(sequences: DataFrame, metrics: dict[str, Callable[[list, list], float]], symbol: str = "aoi", pairs: DataFrame | None = None) -> DataFrame:
    """(id_1, id_2, metric, value) for all pairs of symbol sequences, or those given."""
    schema = "id_1 long, id_2 long, metric string, value double"
    if isinstance(metrics, EditMetrics) and metrics.centers:
        return pairwise.between(pairwise.pack_symbols(sequences, symbol), pairs, batches.EditMeasures(metrics.centers), schema)

    def kernel(one, v, ids, vs):
        mine = list(v)
        for two, w in zip(ids.tolist(), vs, strict=True):
            other = list(w)
            for name, fn in metrics.items():
                yield one, two, name, float(fn(mine, other))

    return pairwise.between(pairwise.pack_symbols(sequences, symbol), pairs, kernel, schema)


def alignments(sequences: DataFrame, symbol: str = "aoi", align: Callable[[list, list], tuple[float, list]] = K.edit_alignment, pairs: DataFrame | None = None) -> DataFrame:
    """(id_1, id_2, score, aligned) for all pairs of symbol sequences, or those given: an alignment as pairs of symbols, ``_`` for a gap."""

    if align in (K.edit_alignment, K.local_alignment):
        kernel = batches.Alignments() if align is K.edit_alignment else batches.LocalAlignments()
        return pairwise.between(pairwise.pack_symbols(sequences, symbol), pairs, kernel, "id_1 long, id_2 long, score double, aligned array<string>")

    def kernel(one, v, ids, vs):
        mine = list(v)
        for two, w in zip(ids.tolist(), vs, strict=True):
            score, places = align(mine, list(w))
            yield one, two, float(score), [(mine[i] if i >= 0 else "_") + (w[j] if j >= 0 else "_") for i, j in places]

    return pairwise.between(pairwise.pack_symbols(sequences, symbol), pairs, kernel, "id_1 long, id_2 long, score double, aligned array<string>")


def warp_links(scanpaths: DataFrame, kind: str = "dtw", pairs: DataFrame | None = None) -> DataFrame:
    """(id_1, id_2, distance, left, right) for all pairs of scanpaths, or those given: the linked places of a warping, ``left[n]`` with ``right[n]``."""
    return pairwise.between(pairwise.pack_points(scanpaths), pairs, batches.WarpLinks(kind), "id_1 long, id_2 long, distance double, left array<int>, right array<int>")


def same_centers(one: dict[str, tuple[float, float]], two: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """The centres that two sequences share; alignments by distance need the same."""
    if not one or one.keys() != two.keys() or any(tuple(one[k]) != tuple(two[k]) for k in one):
        raise ValueError("both sequences need the same centres")
    return one


class EditMetrics(dict):
    """Measures by name, and the centres that all of them share."""

    centers: dict[str, tuple[float, float]] | None = None


def edit_metrics(centers: dict[str, tuple[float, float]] | None = None) -> dict[str, Callable[[list, list], float]]:
    """Levenshtein, generalized edit, Needleman-Wunsch, common subsequence and Smith-Waterman measures, by the longer length."""
    index = {name: n for n, name in enumerate(centers or {})}
    at = np.array(list((centers or {}).values()), float).reshape(-1, 2)
    between = np.hypot(at[:, None, 0] - at[:, 0], at[:, None, 1] - at[:, 1])
    top = float(between.max(initial=0.0)) or 1.0

    def far(s: list, t: list) -> np.ndarray | None:
        return between[np.ix_([index[v] for v in s], [index[v] for v in t])] / top if centers else None

    longer = lambda s, t: max(len(s), len(t), 1)
    found = EditMetrics({
        "levenshtein": lambda s, t: K.weighted_levenshtein(s, t) / longer(s, t),
        "generalized_edit": lambda s, t: K.weighted_levenshtein(s, t, 0.3, 0.3, far(s, t)) / longer(s, t),
        "needleman_wunsch": lambda s, t: -K.needleman_wunsch(s, t, 0.1, 0.25, far(s, t)) / longer(s, t),
        "longest_common_subsequence": lambda s, t: len(K.longest_common_subsequence(s, t)) / longer(s, t),
        # with centres a pair's similarity is a fifth of the largest distance less its own, and the score counts by that threshold
        "smith_waterman": lambda s, t: K.smith_waterman(s, t, 0.2 - far(s, t) if centers else None) / (longer(s, t) * (0.2 * top if centers else 1.0)),
    })
    found.centers = centers
    return found


def shapes(df: DataFrame, width: float, height: float) -> DataFrame:
    """Hull area, Voronoi areas' mean, skewness and gamma scale, Higuchi dimension of the Hilbert index per scanpath."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        pts = g[["x", "y"]].to_numpy(float)
        areas = K.voronoi_areas(pts, width, height)
        sd = areas.std() if len(areas) else 0.0
        cells = np.clip((pts / [width, height] * 16).astype(int), 0, 15)
        index = np.array([K.hilbert_index(int(a), int(b), 4) for a, b in cells], float)
        hull = K.convex_hull(pts)
        shape = K.gamma_shape(areas / areas.mean()) if len(areas) and areas.mean() > 0 else float("nan")
        return pd.DataFrame({"hull_area": [K.polygon_area(hull)], "hull_vertices": [len(hull)], "voronoi_mean": [areas.mean() if len(areas) else np.nan], "voronoi_skewness": [((areas - areas.mean()) ** 3).mean() / sd**3 if sd else np.nan], "voronoi_gamma": [1 / shape], "higuchi": [K.higuchi(index)]})

    return per_recording(df, run, "hull_area double, hull_vertices long, voronoi_mean double, voronoi_skewness double, voronoi_gamma double, higuchi double", ["x", "y"], "k")


def clusters(df: DataFrame, method: str, diagonal: float, neighbours: int | None = None) -> DataFrame:
    """(recording_id, k, aoi): areas by clustering each scanpath: kmeans, dbscan, density_peaks, mean_shift, affinity; noise is dropped, ``dbscan_all`` gives it to the nearest centre, ``mean_shift_near`` drops points far from their mode; ``affinity`` needs a number of ``neighbours`` above ``kernels.AFFINITY_POINTS`` points."""
    methods = {
        "kmeans": K.kmeans_auto,
        "dbscan": lambda p: K.dbscan(p, 0.05 * diagonal),
        "dbscan_all": lambda p: K.to_nearest_centre(p, K.dbscan(p, 0.05 * diagonal)),
        "mean_shift_near": lambda p: K.mean_shift(p, 0.1 * diagonal, orphans=False),
        "density_peaks": lambda p: K.density_peaks(p, 0.1 * diagonal),
        "mean_shift": lambda p: K.mean_shift(p, 0.1 * diagonal),
        "affinity": lambda p: K.affinity_propagation(p, neighbours=neighbours),
    }
    fn = methods[method]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        label = fn(g[["x", "y"]].to_numpy(float))
        keep = label >= 0
        return pd.DataFrame({"k": g.k[keep], "aoi": K.area_names(label[keep])})

    return per_recording(df, run, "k long, aoi string", ["x", "y"], "k")


def hmm_aois(df: DataFrame, states: int | None = 3) -> DataFrame:
    """(recording_id, k, aoi, and the recording's Fisher vector) by a Gaussian model of fixations; without a number of states as many as the best clusters."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        pts = g[["x", "y"]].to_numpy(float)
        model = K.gaussian_hmm_2d(pts, min(states or len(set(K.kmeans_auto(pts).tolist())), len(pts)))
        return pd.DataFrame({"k": g.k, "aoi": K.area_names(model["labels"]), "fisher": [K.fisher_vector(model, pts).tolist()] + [None] * (len(g) - 1)})

    return per_recording(df, run, "k long, aoi string, fisher array<double>", ["x", "y"], "k")


def entropies(transitions: DataFrame) -> DataFrame:
    """Stationary, joint and conditional entropies and mutual information of each recording's transitions (recording_id, src, dst, n)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*g.src, *g.dst})
        p = np.zeros((len(names), len(names)))
        p[[names.index(a) for a in g.src], [names.index(b) for b in g.dst]] = g.n
        found = K.transition_entropies(p / np.maximum(p.sum(1, keepdims=True), 1e-300))
        return pd.DataFrame({k: [v] for k, v in found.items()} | {"aois": [names]})

    return per_recording(transitions, run, "stationary double, joint double, conditional double, mutual_information double, conditional_by_row array<double>, mutual_information_by_row array<double>, aois array<string>", ["dst", "n"], "src")


def fluctuation(df: DataFrame, scales: list[int], order: int = 2, overlap: bool = False) -> DataFrame:
    """Hurst exponents (log-log slope of detrended fluctuation) of x and y."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t = np.array(scales, float)
        return pd.DataFrame({f"hurst_{c}": [K.loglog_slope(t, K.dfa(g[c].to_numpy(float), scales, order, overlap))] for c in "xy"})

    return per_recording(df, run, "hurst_x double, hurst_y double", ["x", "y"])


def persistence(df: DataFrame, least: float) -> DataFrame:
    """Sublevel bars (birth, death) of x."""
    return per_recording(df, lambda g: pd.DataFrame(K.sublevel_bars(g.x.to_numpy(float), least), columns=["birth", "death"]), "birth double, death double", ["x"])


def sine_phase(df: DataFrame, fs: float) -> DataFrame:
    """Amplitude, frequency and phase of the sine that fits x best."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < 8:
            return pd.DataFrame({k: [np.nan] for k in ("amplitude", "frequency", "phase")})
        a, w, p, _ = K.sine_fit(g.i.to_numpy(float) / fs, g.x.to_numpy(float))
        return pd.DataFrame({"amplitude": [a], "frequency": [w / (2 * np.pi)], "phase": [p]})

    return per_recording(df, run, "amplitude double, frequency double, phase double", ["x"])


def phase_difference(df: DataFrame, fs: float) -> DataFrame:
    """Phase of the sine that fits the target (tx) less that of the gaze (x), in radians; null for fewer than eight samples."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < 8:
            return pd.DataFrame({"phase": [np.nan]})
        t = g.i.to_numpy(float) / fs
        return pd.DataFrame({"phase": [K.sine_fit(t, g.tx.to_numpy(float))[2] - K.sine_fit(t, g.x.to_numpy(float))[2]]})

    return per_recording(df, run, "phase double", ["x", "tx"])


def panel_patterns(sequences: DataFrame, panel: str) -> DataFrame:
    """(panel, emine, cdba): a common subsequence and a barycentre for each panel of sequences (recording_id, k, aoi, panel)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seqs = [list(g.sort_values("k").aoi) for _, g in pdf.groupby("recording_id", sort=True)]
        return pd.DataFrame({panel: [pdf[panel].iloc[0]], "emine": ["".join(K.emine(seqs))], "cdba": ["".join(K.cdba(seqs))]})

    return sequences.groupBy(panel).applyInPandas(run, f"{panel} long, emine string, cdba string")


def recurrence(scanpaths: DataFrame, radius: float, shortest: int = 2) -> DataFrame:
    """Recurrence quantification per recording, null where undefined; each recording is packed once and compared with itself in its task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [float(v)] for k, v in pairwise.recurrence(g[["x", "y"]].to_numpy(float), radius, shortest).items()})

    return per_recording(scanpaths, run, "recurrence_rate double, laminarity double, determinism double, corm double, entropy double", ["x", "y"], "k")


def approximate_entropy(df: DataFrame, window: int = 10, tolerance: float = 0.1, column: str = "e") -> DataFrame:
    """Approximate entropy of each recording's series; recordings of at most ``window`` samples are left out."""
    made = per_recording(df, lambda g: pd.DataFrame({"approximate_entropy": [float(np.floor(K.approximate_entropy(g[column].to_numpy(float), window, tolerance) * 1e6 + 0.5001) / 1e6)]}), "approximate_entropy double", [column])
    return made.where(F.col("approximate_entropy").isNotNull() & ~F.isnan("approximate_entropy"))


def lempel_ziv(sequences: DataFrame) -> DataFrame:
    """Number of LZ78 phrases per recording."""
    return per_recording(sequences, lambda g: pd.DataFrame({"complexity": [len(K.lempel_ziv(list(g.aoi)))]}), "complexity long", ["aoi"], "k")


#: Columns that the published features of I-FC read.
IFC_COLUMNS = ["x", "y", "theta_x", "theta_y", "ux", "uy", "uz", "speed_angular"]


def ifc_features(df: DataFrame, fs: float, **options) -> DataFrame:
    """(recording_id, i, and a column for each feature of I-FC by its name) for angular gaze."""
    names = [k for k in K.IFC if options.get("i2mc", True) or k != "i2mc"]

    def run(g: pd.DataFrame, bounds: np.ndarray) -> tuple[dict, np.ndarray]:
        found, m = K.ifc_features({c.replace("speed_angular", "speed"): g[c].to_numpy(float) for c in IFC_COLUMNS}, fs, bounds=bounds, **options)
        return {"i": g.i} | {k: m[:, found.index(k)] for k in names}, K.numbers(bounds)

    return per_batch(df, run, "i long, " + ", ".join(f"{k} double" for k in names), IFC_COLUMNS)


def features(df: DataFrame, kind: str = "fc", reach: int = 5, fs: float = 1.0) -> DataFrame:
    """(recording_id, i, features array<double>): sample features for learning, ``ifc`` as published (angular gaze at ``fs``), ``fc`` simpler ones over ``reach`` samples of any gaze, or direction histograms ``hov``."""
    if kind == "ifc":
        made = ifc_features(df, fs)
        return made.select("recording_id", "i", F.array(*[F.col(c) for c in K.IFC]).alias("features"))

    def run(g: pd.DataFrame, bounds: np.ndarray) -> tuple[dict, np.ndarray]:
        x, y = g.x.to_numpy(float), g.y.to_numpy(float)
        m = K.direction_histograms(x, y, reach, bounds=bounds) if kind == "hov" else K.sample_features(x, y, g.speed.to_numpy(float), reach, max(1, reach // 4), bounds)[1]
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))
        return {"i": g.i, "features": made}, K.numbers(bounds)

    return per_batch(df, run, "i long, features array<double>", ["x", "y", "speed"])
