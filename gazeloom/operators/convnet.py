"""Learned segmentation by a convolutional net (I-CNN) on windows around each sample.

Five times convolution, rectifier and pooling by two, then two full layers and a
softmax, in numpy. Recordings stay in their partitions; a step of the fit broadcasts
the weights, each task sums the gradient over its samples of the step, the sums are
added up by a tree, and Adam moves the weights on the driver, which never sees a
sample. Where that would be more than ``JOBS`` Spark jobs, a job does several steps: each
task moves its own copy of the weights over its share of the samples, batch by batch,
and the copies are averaged by their samples. Windows are cut where they are used, so
a recording is stored once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import per_batch
from .kernels import numbers

#: The published net: channels and kernel widths of its convolutions, units of its hidden layer, samples of a window.
CHANNELS, KERNELS, HIDDEN, WINDOW = (16, 32, 64, 128, 256), (10, 5, 2, 2, 2), 3000, 251
#: Spark jobs of a fit at most, however many samples.
JOBS = 200


def windows(x: np.ndarray, y: np.ndarray, at: np.ndarray, window: int, scale: Sequence[float], first: np.ndarray | int = 0, past: np.ndarray | int | None = None) -> np.ndarray:
    """(samples, 2, window): positions around each place, the first or last sample beyond the ends (``first`` and ``past`` of each place's recording), less the place's own and by the scale."""
    if window < 3 or window % 2 == 0:
        raise ValueError("a window needs an odd number of samples, at least 3")
    low, high = np.broadcast_to(first, at.shape)[:, None], np.broadcast_to(len(x) if past is None else past, at.shape)[:, None] - 1
    near = np.clip(at[:, None] + np.arange(-(window // 2), window // 2 + 1), low, high)
    return np.stack([(v[near] - v[at][:, None]) / s for v, s in zip((x, y), scale, strict=True)], 1)


class Net:
    """Shapes of the layers; weights are a list of arrays."""

    def __init__(self, classes: int, window: int = WINDOW, channels: Sequence[int] = CHANNELS, kernels: Sequence[int] = KERNELS, hidden: int = HIDDEN):
        self.kernels = tuple(kernels)
        shapes, size, before = [], window, 2
        for k, c in zip(kernels, channels, strict=True):
            shapes += [(before * k, c), (c,)]
            size, before = (size - k + 1) // 2, c
        if size < 1:
            raise ValueError("the window is too short for these layers")
        self.shapes = [*shapes, (before * size, hidden), (hidden,), (hidden, classes), (classes,)]

    def start(self, seed: int = 0) -> list[np.ndarray]:
        rng = np.random.default_rng(seed)
        return [rng.normal(0, math.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in self.shapes]

    def forward(self, weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
        """Log probabilities, and what the way back needs."""
        kept = []
        for layer, k in enumerate(self.kernels):
            w, b = weights[2 * layer : 2 * layer + 2]
            n, c, length = x.shape
            cols = np.lib.stride_tricks.sliding_window_view(x, k, 2).transpose(0, 2, 1, 3).reshape(-1, c * k)
            out = (cols @ w + b).reshape(n, length - k + 1, -1)
            half = out.shape[1] // 2
            two = out[:, : 2 * half].reshape(n, half, 2, -1)
            top = two.argmax(2)
            pooled = np.take_along_axis(two, top[:, :, None], 2)[:, :, 0]
            kept.append((cols, x.shape, out.shape, top, pooled > 0))
            x = np.maximum(pooled, 0).transpose(0, 2, 1)
        flat = x.reshape(len(x), -1)
        w1, b1, w2, b2 = weights[-4:]
        hidden = flat @ w1 + b1
        score = np.maximum(hidden, 0) @ w2 + b2
        score = score - score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True)), [kept, x.shape, flat, hidden]

    def gradient(self, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Sum of the samples' negative log likelihoods, and its gradient."""
        log_p, (kept, shape, flat, hidden) = self.forward(weights, x)
        at = np.arange(len(y))
        back = np.exp(log_p)
        back[at, y] -= 1
        w1, _, w2, _ = weights[-4:]
        out = [np.maximum(hidden, 0).T @ back, back.sum(0)]
        back = (back @ w2.T) * (hidden > 0)
        out = [flat.T @ back, back.sum(0), *out]
        back = (back @ w1.T).reshape(shape)
        for layer in range(len(self.kernels) - 1, -1, -1):
            cols, in_shape, out_shape, top, positive = kept[layer]
            k, w = self.kernels[layer], weights[2 * layer]
            two = np.zeros((out_shape[0], out_shape[1] // 2, 2, out_shape[2]))
            np.put_along_axis(two, top[:, :, None], (back.transpose(0, 2, 1) * positive)[:, :, None], 2)
            wide = np.zeros(out_shape)
            wide[:, : 2 * two.shape[1]] = two.reshape(out_shape[0], -1, out_shape[2])
            rows = wide.reshape(-1, out_shape[2])
            out = [cols.T @ rows, rows.sum(0), *out]
            spread = (rows @ w.T).reshape(in_shape[0], out_shape[1], in_shape[1], k)
            back = np.zeros(in_shape)
            for j in range(k):
                back[:, :, j : j + out_shape[1]] += spread[:, :, :, j].transpose(0, 2, 1)
        return -float(log_p[at, y].sum()), out


@dataclass
class Fitted:
    """A fitted net with its labels and scale."""

    net: Net
    weights: list[np.ndarray]
    labels: list[int]
    scale: tuple[float, float]
    window: int
    losses: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """(recording_id, i, prediction) for gaze (recording_id, i, x, y)."""
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(g: pd.DataFrame, bounds: np.ndarray) -> tuple[dict, np.ndarray]:
            m, which = sent.value, numbers(bounds)
            x, y, labels, first, past = g.x.to_numpy(float), g.y.to_numpy(float), np.array(m.labels), bounds[:-1][which], bounds[1:][which]
            out = [labels[m.net.forward(m.weights, windows(x, y, np.arange(a, min(a + 512, len(g))), m.window, m.scale, first[a : a + 512], past[a : a + 512]))[0].argmax(1)] for a in range(0, len(g), 512)]
            return {"i": g.i, "prediction": np.concatenate(out).astype(float)}, which

        return per_batch(df, run, "i long, prediction double", ["x", "y"])


def fit(gaze: DataFrame, labels: DataFrame, window: int = WINDOW, channels: Sequence[int] = CHANNELS, kernels: Sequence[int] = KERNELS, hidden: int = HIDDEN, epochs: int = 25, batch: int = 1024, rate: float = 1e-3, seed: int = 0) -> Fitted:
    """Fit on samples with a label above 0, by steps of about ``batch`` samples (drawn anew for each step, by seeds of step and recording), as many as make ``epochs`` passes.

    A step is a Spark job up to ``JOBS`` of them; more samples make more steps in a job, side by side in its tasks.
    """
    rows = gaze.select("recording_id", "i", "x", "y").join(labels.select("recording_id", "i", "label"), ["recording_id", "i"], "left")
    whole = rows.where("label > 0").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y"), F.sort_array(F.collect_set("label")).alias("labels")).first()
    if not whole["n"]:
        raise ValueError("no labelled samples")
    scale, names, n = (whole["x"] or 1.0, whole["y"] or 1.0), [int(v) for v in whole["labels"]], whole["n"]
    net = Net(len(names), window, channels, kernels, hidden)
    number = {v: k for k, v in enumerate(names)}
    packed = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", F.coalesce("label", F.lit(0)).alias("label")))).alias("g"))

    def arrays(r) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return r["recording_id"], np.array([p["x"] for p in r["g"]], float), np.array([p["y"] for p in r["g"]], float), np.array([number.get(int(p["label"]), -1) for p in r["g"]], np.int8)

    spark = gaze.sparkSession.sparkContext
    held = packed.rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    steps = epochs * math.ceil(n / batch)
    if steps > JOBS:
        return _fit_apart(spark, held, net, scale, names, n, epochs, batch, rate, seed, window)
    share = min(1.0, batch / n)
    adam, losses = Adam(net.start(seed), rate), []
    for step in range(1, steps + 1):
        sent = spark.broadcast(adam.weights)

        def part(recordings, step=step, sent=sent):
            loss, count, total = 0.0, 0, None
            for recording, x, y, label in recordings:
                known = np.flatnonzero(label >= 0)
                draws = np.random.default_rng([seed, step, recording & 0x7FFFFFFFFFFFFFFF]).random(len(known))
                at = known[draws < share]
                for a in range(0, len(at), 256):
                    cut = at[a : a + 256]
                    more, grad = net.gradient(sent.value, windows(x, y, cut, window, scale), label[cut])
                    loss, count = loss + more, count + len(cut)
                    total = grad if total is None else [p + q for p, q in zip(total, grad, strict=True)]
            if count:
                yield loss, count, total

        added = held.mapPartitions(part).treeAggregate(None, _add, _add)
        sent.unpersist()
        if added is None:
            continue
        loss, count, grad = added
        losses.append(loss / count)
        adam.move([g / count for g in grad], step)
    held.unpersist()
    return Fitted(net, adam.weights, names, scale, window, losses)


class Adam:
    """Weights and the running means of their gradients."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate = weights, rate
        self.m, self.v = [np.zeros(w.shape) for w in weights], [np.zeros(w.shape) for w in weights]

    def move(self, grad: list[np.ndarray], step: int) -> None:
        for k, g in enumerate(grad):
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.weights[k] = self.weights[k] - self.rate * (self.m[k] / (1 - 0.9**step)) / (np.sqrt(self.v[k] / (1 - 0.999**step)) + 1e-8)


def _joined(recordings) -> list[tuple[np.ndarray, ...]]:
    """A partition's recordings as one: (x, y, label, first, past, known), the places of labelled samples last."""
    rows = list(recordings)
    if not rows:
        return []
    x, y, label = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
    bounds = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    which = numbers(bounds)
    return [(x, y, label, bounds[:-1][which], bounds[1:][which], np.flatnonzero(label >= 0))]


def _fit_apart(spark, held, net: Net, scale: tuple[float, float], names: list[int], n: int, epochs: int, batch: int, rate: float, seed: int, window: int) -> Fitted:
    """The fit in ``JOBS`` jobs: in each a task goes through its share of its samples, by steps of at most ``batch``, and the tasks' weights are averaged."""
    joined = held.mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)
    adam, losses, step = Adam(net.start(seed), rate), [], 0
    for job in range(JOBS):
        sent = spark.broadcast((adam, step))

        def part(number, parts, job=job, sent=sent):
            for x, y, label, first, past, known in parts:
                # each pass deals the samples anew over its jobs, so that all have their turn
                lo, hi = (int(len(known) * epochs * k / JOBS) for k in (job, job + 1))
                order = np.concatenate([np.random.default_rng([seed, turn, number]).permutation(known) for turn in range(lo // max(1, len(known)), -(-hi // max(1, len(known))))] or [known])
                order = order[lo % max(1, len(known)) :][: hi - lo]
                start, at_step = sent.value
                mine, loss = Adam([w.copy() for w in start.weights], rate), 0.0
                mine.m, mine.v = [m.copy() for m in start.m], [v.copy() for v in start.v]
                pieces = np.array_split(order, -(-len(order) // batch)) if len(order) else []
                for piece in pieces:
                    total = None
                    for a in range(0, len(piece), 256):
                        cut = piece[a : a + 256]
                        more, grad = net.gradient(mine.weights, windows(x, y, cut, window, scale, first[cut], past[cut]), label[cut])
                        loss += more
                        total = grad if total is None else [p + q for p, q in zip(total, grad, strict=True)]
                    at_step += 1
                    mine.move([g / len(piece) for g in total], at_step)
                if pieces:
                    k = len(order)
                    yield loss, k, [k * w for w in (*mine.weights, *mine.m, *mine.v, np.array(float(at_step)))]

        added = joined.mapPartitionsWithIndex(part).treeAggregate(None, _add, _add)
        sent.unpersist()
        held.unpersist()
        if added is None:
            continue
        loss, count, total = added
        losses.append(loss / count)
        total, size = [w / count for w in total], len(net.shapes)
        adam.weights, adam.m, adam.v, step = total[:size], total[size : 2 * size], total[2 * size : 3 * size], round(float(total[-1]))
    joined.unpersist()
    return Fitted(net, adam.weights, names, scale, window, losses)


def _add(a, b):
    if a is None or b is None:
        return a if b is None else b
    return a[0] + b[0], a[1] + b[1], [p + q for p, q in zip(a[2], b[2], strict=True)]
