"""Learned segmentation with pyspark.ml: sample features, scaling, a classifier, then the duration filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import takewhile
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.relational import Plan
from . import convnet
from .common import settled
from .grouped import features
from .islands import two_class
from .kernels import area_names
from .neighbours import Neighbours
from .segmentation import three_class

CLASSIFIERS = {
    "rf": lambda n: RandomForestClassifier(maxDepth=10, numTrees=20, featureSubsetStrategy="sqrt", seed=0, featuresCol="scaled"),
    "svm": lambda n: OneVsRest(classifier=LinearSVC(maxIter=20), featuresCol="scaled", labelCol="class", predictionCol="number"),
    "mlp": lambda n: MultilayerPerceptronClassifier(layers=[n, 32, 4], maxIter=60, seed=0, featuresCol="scaled"),
}

#: Rows whose Fourier features a task holds at a time, and steps along a direction that a pass tries.
LIFTED_ROWS, STEPS = 5000, 2.0 ** np.arange(2, -8, -1)
#: Starts of k-means that run at a time.
STARTS = 4
#: Training samples of the neighbour classifier in a cell, about; what a task holds at a time.
NEIGHBOUR_ROWS = 50_000


def fourier_features(x: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Features whose products are about the kernel of the points."""
    return np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)


def _summed(rows: DataFrame, made: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows (x array<double>, label) of the ``width`` numbers that ``made`` has for each batch of them; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for a in range(0, len(b), LIFTED_ROWS):
                c = b.slice(a, LIFTED_ROWS)
                total += made(c.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1), c.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["place", "total"])

    out = np.zeros(width)
    for r in rows.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out


class Descent:
    """Limited-memory BFGS of one function whose values and gradients come for all ``STEPS`` along a direction at once."""

    def __init__(self, at: np.ndarray, value: float, slope: np.ndarray, held: int = 10):
        self.at, self.value, self.slope, self.held, self.past, self.done = at, value, slope, held, [], not slope.any()

    def direction(self) -> np.ndarray:
        d, back = self.slope.copy(), []
        for s, y in reversed(self.past):
            back.append((s @ d) / (s @ y))
            d -= back[-1] * y
        d *= (self.past[-1][0] @ self.past[-1][1]) / (self.past[-1][1] @ self.past[-1][1]) if self.past else 1 / np.linalg.norm(d)
        for (s, y), a in zip(self.past, reversed(back), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        return -d if d @ self.slope > 0 else -self.slope

    def go(self, direction: np.ndarray, values: np.ndarray, slopes: np.ndarray, tolerance: float = 1e-6) -> None:
        """To the step of the least value; ends where even steepest descent gains nothing."""
        best = values.argmin()
        if not values[best] < self.value:
            self.done, self.past = not self.past, []
            return
        s, y = STEPS[best] * direction, slopes[best] - self.slope
        self.done = self.value - values[best] <= tolerance * abs(self.value)
        self.at, self.value, self.slope = self.at + s, values[best], slopes[best]
        if s @ y > 1e-12:
            self.past = [*self.past, (s, y)][-self.held :]


class KernelMachine:
    """Linear machines, one against the rest, on random Fourier features of a Gaussian kernel.

    ``size`` cosines of seeded random directions stand in for the kernel exp(-gamma |x - y|^2). The features are made in each task, a batch of rows
    at a time, and never kept: a pass sums losses and gradients of all machines and steps. The loss is that of ``LinearSVC``: hinge, features in their deviations, squared weights.
    """

    def __init__(self, width: int, gamma: float | None = None, size: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.gamma = gamma or 1.0 / width
        self.directions = rng.normal(0, np.sqrt(2 * self.gamma), (width, size))
        self.phases = rng.uniform(0, 2 * np.pi, size)
        self.scaler: PipelineModel | None = None
        self.labels, self.weights, self.loss = np.zeros(0), np.zeros((0, size + 1)), np.zeros(0)

    def fit(self, rows: DataFrame, rounds: int = 20, penalty: float = 1e-4) -> KernelMachine:
        self.scaler = Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)]).fit(rows)
        directions, phases, size = self.directions, self.phases, len(self.phases)
        x = self.scaler.transform(rows).select("label", vector_to_array("scaled").alias("x"))
        self.labels = labels = np.array(sorted(r["label"] for r in rows.select("label").distinct().collect()))

        def moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            f = fourier_features(x, directions, phases)
            return np.concatenate([[len(f)], f.sum(0), (f * f).sum(0)])

        n, *sums = _summed(x, moments, 2 * size + 1)
        mean, square = np.array(sums).reshape(2, size) / n
        deviation = np.sqrt(np.maximum(square - mean * mean, 0.0) * n / max(n - 1, 1))
        scale = np.divide(1.0, deviation, out=np.zeros(size), where=deviation > 1e-9)

        def tried(at: np.ndarray, along: np.ndarray, classes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Losses (machines, steps) and their gradients."""
            shape = (len(at), len(steps))

            def made(x: np.ndarray, label: np.ndarray) -> np.ndarray:
                f = np.append((fourier_features(x, directions, phases) - mean) * scale, np.ones((len(x), 1)), 1)
                sign = np.where(label[:, None] == classes, 1.0, -1.0)[:, :, None]
                short = 1 - sign * ((f @ at.T)[:, :, None] + (f @ along.T)[:, :, None] * steps)
                inside = short > 0
                return np.concatenate([(short * inside).sum(0).ravel(), ((-sign * inside).reshape(len(x), -1).T @ f).ravel()])

            total = _summed(x, made, math.prod(shape) * (size + 2)) / n
            weights = at[:, None] + along[:, None] * steps[:, None]
            weights[:, :, -1] = 0.0
            values = total[: math.prod(shape)].reshape(shape) + penalty / 2 * (weights**2).sum(2)
            return values, total[math.prod(shape) :].reshape(*shape, size + 1) + penalty * weights

        start = np.zeros((len(labels), size + 1))
        values, slopes = tried(start, start, labels, np.zeros(1))
        machines = [Descent(w, v[0], g[0]) for w, v, g in zip(start, values, slopes, strict=True)]
        for _ in range(rounds):
            moving = [c for c, m in enumerate(machines) if not m.done]
            if not moving:
                break
            along = np.array([machines[c].direction() for c in moving])
            values, slopes = tried(np.array([machines[c].at for c in moving]), along, labels[moving], STEPS)
            for c, d, v, g in zip(moving, along, values, slopes, strict=True):
                machines[c].go(d, v, g)
        self.loss = np.array([m.value for m in machines])
        # weights of the features as they are
        found = np.array([m.at for m in machines])
        self.weights = np.append(found[:, :-1] * scale, found[:, -1:] - (found[:, :-1] * scale) @ mean[:, None], 1)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        directions, phases, weights, labels = self.directions, self.phases, self.weights, self.labels

        @F.pandas_udf("double")
        def decided(rows: pd.Series) -> pd.Series:
            parts = (np.stack(rows.iloc[a : a + LIFTED_ROWS].to_list()) for a in range(0, len(rows), LIFTED_ROWS))
            return pd.Series([v for p in parts for v in labels[(fourier_features(p, directions, phases) @ weights[:, :-1].T + weights[:, -1]).argmax(1)]], dtype=float)

        return self.scaler.transform(df).withColumn("prediction", decided(vector_to_array("scaled")))


def _nearest(x: np.ndarray, y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre, the first at a tie."""
    at, least = np.zeros(len(x), np.intp), np.full(len(x), np.inf)
    for c, (cx, cy) in enumerate(centres):
        dx, dy = x - cx, y - cy
        far = dx * dx + dy * dy
        at[far < least] = c
        np.minimum(least, far, out=least)
    return at


def _held(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each set of centres a row a centre: its points' number, sums of x and of y, and sum of squares, all sets in one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {n: np.zeros((len(c), 4)) for n, c in centres.items()}
        for b in batches:
            x, y = b.x.to_numpy(), b.y.to_numpy()
            square = x * x + y * y
            for n, c in centres.items():
                at = _nearest(x, y, c)
                for j, w in enumerate((None, x, y, square)):
                    sums[n][:, j] += np.bincount(at, w, len(c))
        yield pd.DataFrame([(n, c, *row) for n, s in sums.items() for c, row in enumerate(s)], columns=["n", "c", "held", "sx", "sy", "square"])

    parts = points.mapInPandas(run, "n int, c int, held double, sx double, sy double, square double").groupBy("n", "c")
    out = {n: np.zeros((len(c), 4)) for n, c in centres.items()}
    for r in parts.agg(F.sum("held"), F.sum("sx"), F.sum("sy"), F.sum("square")).collect():
        out[r["n"]][r["c"]] = r[2:]
    return out


def _settled_centres(points: DataFrame, starts: dict[int, np.ndarray], rounds: int = 20, tolerance: float = 1e-4) -> dict[int, np.ndarray]:
    """Rounds of k-means as in ``pyspark.ml``, those of all sets of centres in one job: a set ends when no centre moves by more than ``tolerance``."""
    now, moving = dict(starts), set(starts)
    for _ in range(rounds):
        for n, sums in _held(points, {n: now[n] for n in sorted(moving)}).items():
            new = np.where(sums[:, :1] > 0, sums[:, 1:3] / np.maximum(sums[:, :1], 1), now[n])
            if (((new - now[n]) ** 2).sum(1) <= tolerance**2).all():
                moving.remove(n)
            now[n] = new
        if not moving:
            break
    return now


def _silhouettes(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette by squared distances of each set of centres, as ``ClusteringEvaluator`` has it; sets with one cluster of points are left out."""
    sums = {n: s for n, s in _held(points, centres).items() if (s[:, 0] > 0).sum() > 1}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = dict.fromkeys(sums, 0.0), 0
        for b in batches:
            x, y = b.x.to_numpy(), b.y.to_numpy()
            count += len(b)
            for n, s in sums.items():
                at = _nearest(x, y, centres[n])
                own, other = np.zeros(len(b)), np.full(len(b), np.inf)
                for c, (held, sx, sy, square) in enumerate(s):
                    if held:
                        mean = x * x + y * y + square / held - 2 * (x * sx + y * sy) / held
                        mine = at == c
                        own[mine] = mean[mine] * held / max(held - 1, 1)
                        other[~mine] = np.minimum(other, mean)[~mine]
                with np.errstate(invalid="ignore", divide="ignore"):
                    fit = np.where(own < other, 1 - own / other, np.where(own > other, other / own - 1, 0.0))
                total[n] += float(fit[s[at, 0] > 1].sum())
        yield pd.DataFrame([(n, t, count) for n, t in total.items()], columns=["n", "total", "count"])

    return {r["n"]: r["score"] for r in points.mapInPandas(run, "n int, total double, count long").groupBy("n").agg((F.sum("total") / F.sum("count")).alias("score")).collect()}


def joint_areas(points: DataFrame, most: int = 15, seed: int = 0) -> DataFrame:
    """(recording_id, k, aoi, cx, cy): areas of interest shared by all recordings, by k-means over all points (recording_id, k, x, y) together.

    Of 2 to ``most`` clusters the number with the best silhouette counts. Letters go by the centre's x, then y. With fewer than three different points all are one area.
    Each number starts from ``pyspark.ml``'s seeded start over all points; rounds and silhouettes of all numbers share their passes.
    """
    rows = points.select("recording_id", "k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = rows.withColumn("at", array_to_vector(F.array("x", "y")))
    rows.persist()  # read by every start and every round; lost parts are made again
    # three rows at most come back; whether there are as many is all that counts
    if rows.select("x", "y").distinct().limit(3).count() < 3:
        rows.unpersist()
        middle = rows.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        return rows.select("recording_id", "k", F.lit("A").alias("aoi")).crossJoin(F.broadcast(middle))

    def start(n: int) -> np.ndarray:
        return np.array(KMeans(k=n, seed=seed, maxIter=0, featuresCol="at", predictionCol="cluster").fit(rows).clusterCenters())

    # starts are short jobs one after the other, so several numbers run side by side
    with ThreadPool(STARTS) as pool:
        made = pool.map(inheritable_thread_target(points.sparkSession)(start), range(2, most + 1))
    starts = dict(takewhile(lambda s: len(s[1]) == s[0], enumerate(made, 2)))
    found = _settled_centres(rows.select("x", "y"), starts)
    scores = _silhouettes(rows.select("x", "y"), found)
    rows.unpersist()
    best = max(sorted(scores), key=scores.__getitem__)
    centers = [(float(x), float(y)) for x, y in found[best]]
    order = sorted(range(best), key=centers.__getitem__)
    names = dict(zip(order, area_names(np.arange(best)), strict=True))
    far = [F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d"), F.lit(i).alias("i"), F.lit(names[i]).alias("aoi"), F.lit(x).alias("cx"), F.lit(y).alias("cy")) for i, (x, y) in enumerate(centers)]
    return rows.withColumn("near", F.array_min(F.array(*far))).select("recording_id", "k", "near.aoi", "near.cx", "near.cy")


def fit_neighbours(rows: DataFrame, k: int = 3, most: int = NEIGHBOUR_ROWS) -> Neighbours:
    """From rows with ``recording_id, i, vector, label``, all of them; ``most`` samples, about, lie in a cell."""
    if rows.isEmpty():
        raise ValueError("no labelled samples")
    scaler = Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="scaled", withMean=True)]).fit(rows)
    points = scaler.transform(rows).select(vector_to_array("scaled").alias("x"), F.col("label").cast("int").alias("y"))
    # of equal samples no more than k can be among the nearest
    points = points.groupBy("x", "y").count().select("x", "y", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int"))).alias("n")).drop("n")
    return Neighbours(scaler, settled(points), k, most)


def vectors(gaze: DataFrame, kind: str, reach: int, fs: float = 1.0) -> DataFrame:
    return features(gaze, kind, reach, fs).withColumn("vector", array_to_vector("features")).drop("features")


def fit(gaze: DataFrame, labels: DataFrame, kind: str = "fc", classifier: str = "rf", reach: int = 5, net: dict | None = None, fs: float = 1.0, mask: str = "label > 0") -> PipelineModel | Neighbours | KernelMachine | convnet.Fitted:
    """Fit on labelled samples that ``mask`` keeps (an expression over the columns of ``labels``): ``rf``, ``svm`` (linear), ``rbf`` (Gaussian kernel), ``knn`` (keeps all samples), ``mlp``, or ``cnn``, which reads windows instead of features and takes the options of :func:`.convnet.fit`."""
    labels = labels.where(mask)
    if classifier == "cnn":
        return convnet.fit(gaze, labels, **(net or {}))
    rows = vectors(gaze, kind, reach, fs).join(labels.select("recording_id", "i", "label"), ["recording_id", "i"]).withColumn("label", F.col("label").cast("double"))
    rows.persist()  # read by each stage and its rounds, features are made once; lost parts are made again
    try:
        return _fit_rows(rows, classifier)
    finally:
        rows.unpersist()


def _fit_rows(rows: DataFrame, classifier: str) -> PipelineModel | Neighbours | KernelMachine:
    if classifier == "knn":
        return fit_neighbours(rows)
    width = len(rows.select(vector_to_array("vector").alias("v")).first()["v"]) if classifier in ("mlp", "rbf") else 0
    if classifier == "rbf":
        return KernelMachine(width).fit(rows)
    stages = [StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), CLASSIFIERS[classifier](width)]
    if classifier == "svm":
        # one machine for each label that occurs; a machine without examples of its label can't be fitted
        classes: StringIndexerModel = StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc").fit(rows)
        stages = [stages[0], classes, stages[1], IndexToString(inputCol="number", outputCol="prediction", labels=classes.labels)]
    return Pipeline(stages=stages).fit(rows)


def predict(gaze: DataFrame, model: PipelineModel | Neighbours | KernelMachine | convnet.Fitted, kind: str = "fc", reach: int = 5, fs: float = 1.0, limits: dict | None = None, task: str = "ternary") -> DataFrame:
    """(recording_id, i, label): raw, or with duration ``limits`` filtered as those of the threshold methods.

    ``task`` ternary takes ``fix`` and ``pursuit`` in seconds (what they reject becomes 2,
    saccade); binary takes ``min_fix``, ``max_fix``, ``min_sac`` and ``status_threshold``
    and needs ``status`` in ``gaze``.
    """
    rows = gaze if isinstance(model, convnet.Fitted) else vectors(gaze, kind, reach, fs)
    raw = model.transform(rows).select("recording_id", "i", F.col("prediction").cast("double").cast("int").alias("label"))
    if limits is None:
        return raw
    if task == "ternary":
        plan = three_class(Plan().then("raw", "SELECT recording_id, i, label FROM {raw}"), "raw", "lab", fs, **limits)
        return plan.then("out", "SELECT recording_id, i, label FROM lab").spark(gaze.sparkSession, raw=raw)
    if task != "binary":
        raise ValueError("task is binary or ternary")
    plan = two_class(Plan().then("raw", "SELECT recording_id, i, label AS scan, status FROM {raw}"), "raw", "lab", "scan = 1", fs, **limits)
    return plan.then("out", "SELECT recording_id, i, label FROM lab").spark(gaze.sparkSession, raw=raw.join(gaze.select("recording_id", "i", "status"), ["recording_id", "i"]))
