"""Toxicity: cumulative-link ordinal regression on sparse word features.

``P(grade <= k) = logistic(theta_k - w.x)`` with one weight vector for all ordered
thresholds; ``x`` marks which of the chosen words a text holds. The expected severity
is the sum of ``P(grade > k)`` over the steps between grades.

Grades come from the labels alone: any whole numbers, the least of which is "not
toxic" (0 and what is below it count as 0). Labels with two values give one threshold.

Fitting uses a bounded sample of labelled rows (``max_labelled`` expected rows, chosen
by a hash of the id) and reads their whole texts. Words enter if their share among the
positive rows differs from that among the others by ``min_z`` standard errors, at most
``max_features`` of them, so what the driver sees is bounded: a row a document and a
mark for each chosen word in it. Words are split and counted by built-in functions. The
penalty is the one of ``PENALTIES`` under which a fit on four fifths of the sample (dealt by
the ids' order) makes the labels of the rest most likely; it then holds for a fit on all.

Edge cases: null and empty texts have no features and get the base rate; null labels
are left out; of repeated labels of a row the highest counts, of repeated documents
the least text; without positive or without negative labels, or without documents,
everything gets severity 0; columns of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, text_of
from .storage import drop, stash
from .wumanber import words_of

MAX_LABELLED = 8000
MAX_FEATURES = 4096
MIN_Z = 4.0
#: Penalties of the fit to choose from, and the fifth of the labelled rows that chooses.
PENALTIES, FOLDS = (1.0, 0.3, 0.1, 0.03), 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class CumulativeLink:
    """Weights by word, ordered thresholds, and the grades that they part."""

    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.words, self.weights, self.thresholds, self.grades = words, weights, thresholds, np.asarray(grades, np.int64)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        return _sigmoid(eta[:, None] - self.thresholds[None, :])


NEVER = CumulativeLink([], np.zeros(0), np.array([np.inf]), [0, 1])


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, l2: float = 1.0, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood by Adam over marks (row, column); returns weights and thresholds.

    Thresholds are a first one plus exponentials, so they stay ordered.
    """
    n, top = len(grades), int(grades.max())
    share = np.array([np.clip((grades <= k).mean(), 1e-3, 1 - 1e-3) for k in range(top)])
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    params = np.concatenate([np.zeros(n_features), free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, free = params[:n_features], params[n_features:]
        gaps = np.exp(free[1:])
        theta = np.cumsum(np.concatenate([free[:1], gaps]))
        eta = np.bincount(rows, w[cols], n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - eta[:, None]), np.ones((n, 1))], 1)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        slope = below * (1 - below)
        upper, lower = slope[at, grades + 1] / p, slope[at, grades] / p
        d_eta = upper - lower
        d_theta = np.zeros(top + 2)
        np.add.at(d_theta, grades + 1, -upper)
        np.add.at(d_theta, grades, lower)
        d_theta = d_theta[1 : top + 1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, d_eta[rows], n_features) + l2 * w, tail[:1], tail[1:] * gaps]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = params[n_features:]
    return params[:n_features], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def log_likelihood(eta: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> float:
    """Sum of the logarithms of the grades' probabilities."""
    below = np.concatenate([np.zeros((len(eta), 1)), _sigmoid(thresholds[None, :] - eta[:, None]), np.ones((len(eta), 1))], 1)
    at = np.arange(len(eta))
    return float(np.log(np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)).sum())


def choose_penalty(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, penalties: tuple[float, ...] = PENALTIES, folds: int = FOLDS) -> float:
    """The penalty whose fit without every ``folds``-th row makes the grades of these most likely; the first where a grade would be missing."""
    held = np.arange(len(grades)) % folds == folds - 1
    if len(penalties) == 1 or set(grades[~held].tolist()) != set(grades.tolist()):
        return penalties[0]
    place = np.cumsum(~held) - 1
    kept = ~held[rows]
    scores = []
    for l2 in penalties:
        w, theta = fit_cumulative_link(place[rows[kept]], cols[kept], grades[~held], n_features, l2)
        scores.append(log_likelihood(np.bincount(rows, w[cols], len(grades))[held], theta, grades[held]))
    return penalties[int(np.argmax(scores))]


def distinct_words(text: Column) -> Column:
    """The distinct words of a text as :func:`~.wumanber.words_of` splits them, by built-in functions."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.array_distinct(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")), "")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_z: float = MIN_Z, penalties: tuple[float, ...] = PENALTIES) -> CumulativeLink:
    """Fit on a bounded sample of labelled rows."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.greatest(F.max(label), F.lit(0)).cast("int").alias("grade"))
    share = min(1.0, max_labelled / max(1, known.count()))
    # at most about max_labelled rows of two numbers: bounded, so it may be broadcast
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)))
    texts = docs.select(F.col(id_col), F.col(text).alias("text")).join(chosen, id_col).groupBy(id_col).agg(F.max("grade").alias("grade"), F.min("text").alias("text"))
    sample = stash(texts.select(F.col(id_col).alias("id"), "grade", distinct_words(F.col("text")).alias("words")), "labelled")
    known_rows = sample.select("id", "grade").orderBy("id").toPandas()
    levels, grades = np.unique(np.append(known_rows.grade.to_numpy(np.int64), 0), return_inverse=True)
    grades = grades[:-1]
    n, p = len(grades), int((grades > 0).sum())
    if not p or p == n:
        drop(sample)
        return NEVER
    marks = sample.select("id", (F.col("grade") > 0).cast("long").alias("y"), F.explode("words").alias("word"))
    by_word = marks.groupBy("word").agg(F.count("*").alias("d"), F.sum("y").alias("dp"))
    pooled = (F.col("d") + 1) / (n + 2)
    z = (F.col("dp") / p - (F.col("d") - F.col("dp")) / (n - p)) / F.sqrt(pooled * (1 - pooled) * (1 / p + 1 / (n - p)))
    words = [r["word"] for r in by_word.where("d >= 3").select("word", F.abs(z).alias("z")).where(F.col("z") >= min_z).orderBy(F.desc("z"), "word").limit(max_features).collect()]
    numbered = docs.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, number int")
    got = marks.join(F.broadcast(numbered), "word").select("id", "number").orderBy("id", "number").toPandas()
    drop(sample)
    rows = np.searchsorted(known_rows.id.to_numpy(), got.id.to_numpy())
    cols = got.number.to_numpy(np.int64)
    w, theta = fit_cumulative_link(rows, cols, grades, len(words), choose_penalty(rows, cols, grades, len(words), penalties))
    return CumulativeLink(words, w, theta, levels.tolist())


def predict(df: DataFrame, model: CumulativeLink, text: str = "text") -> DataFrame:
    """Add ``expected_severity double``, ``p_toxic double``, ``severity int`` (the median grade) and ``toxic boolean`` (p_toxic at least a half, which is severity > 0). Columns of these names are replaced."""
    names = ["expected_severity", "p_toxic", "severity", "toxic"]
    kept = [c for c in df.columns if c not in names]
    kinds = [T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = {w.encode(): x for w, x in zip(model.words, model.weights.tolist(), strict=True)}
        known, steps = weight.keys(), np.diff(model.grades)
        for batch in slices(batches, text):
            eta = np.array([sum(weight[w] for w in sorted(known & set(words_of(x)))) for x in text_of(batch, text)], float)
            above = model.above(eta)
            grade = model.grades[(above >= 0.5).sum(1)]
            out = [pa.array(above @ steps), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, names=kept + names)

    return df.mapInArrow(run, schema)
