"""Learned segmentation and sequential patterns against brute force."""

from itertools import product

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gazeloom.operators import learning, mining
from gazeloom.plans import kernels


def test_neighbours_vote(spark):
    rng = np.random.default_rng(0)
    rows = [(1, k, [float(v) for v in rng.normal(3 * (k % 3), 0.8, 2)], float(1 + k % 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "recording_id long, i long, f array<double>, label double").withColumn("vector", array_to_vector("f"))
    model = learning.fit_neighbours(df.where("i < 240"), most=10**6)
    x = np.array([r[2] for r in rows])
    z = (x - x[:240].mean(0)) / x[:240].std(0, ddof=1)
    want = {k: int(np.bincount([int(rows[j][3]) for j in np.argsort(((z[:240] - z[k]) ** 2).sum(1))[:3]]).argmax()) for k in range(240, 300)}
    assert {r.i: int(r.prediction) for r in model.transform(df.where("i >= 240")).collect()} == want
    with pytest.raises(ValueError):
        learning.fit_neighbours(df.limit(0))


def test_sequential_patterns(spark):
    seqs = {1: "ABCA", 2: "BCAB", 3: "CAB", 4: "AC", 5: "B"}
    df = spark.createDataFrame([(i, k, a) for i, s in seqs.items() for k, a in enumerate(s)] + [(5, 9, None)], "recording_id long, k long, aoi string")

    def holds(s, p):
        it = iter(s)
        return all(c in it for c in p)

    want = {",".join(p): n for m in (1, 2, 3) for p in product("ABC", repeat=m) if (n := sum(holds(s, p) for s in seqs.values())) >= 2.5}
    got = mining.sequential_patterns(df, longest=3, top=None).collect()
    assert {r.pattern: r.support for r in got} == want and all(r.share == r.support / 5 for r in got)
    first = mining.sequential_patterns(df, longest=3, top=2).collect()
    assert [(r.pattern) for r in first] == [p for p, _ in sorted(want.items(), key=lambda x: (x[1], len(x[0]), x[0]), reverse=True)[:2]]
    assert mining.sequential_patterns(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["learn_machines", "learn_neighbours", "learn_directions", "aoi_frequent_patterns"])
def test_learned_queries_run(spark, sf, name):
    out = kernels.QUERIES[name](spark, sf)
    assert out.count() > 0
    if name.startswith("learn"):
        assert {r.label for r in out.select("label").distinct().collect()} <= {0, 1, 2, 3}


def test_joint_areas_are_those_of_single_fits_in_few_jobs(spark):
    rng = np.random.default_rng(8)
    rows = [(i % 30, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal([[0, 0], [9, 1], [4, 30], [50, 5]], 3.0, (150, 4, 2)).reshape(-1, 2))]
    df = spark.createDataFrame(rows, "recording_id long, k long, x double, y double").repartition(3, "recording_id").persist()
    at = df.withColumn("at", array_to_vector(F.array("x", "y"))).persist()
    fits = [KMeans(k=n, seed=0, featuresCol="at", predictionCol="cluster").fit(at) for n in range(2, 9)]
    scores = [ClusteringEvaluator(featuresCol="at", predictionCol="cluster").evaluate(m.transform(at)) for m in fits]
    centres = {n: np.array(m.clusterCenters()) for n, m in enumerate(fits, 2)}
    starts = {n: np.array(KMeans(k=n, seed=0, maxIter=0, featuresCol="at", predictionCol="cluster").fit(at).clusterCenters()) for n in centres}
    tracker, before = spark.sparkContext.statusTracker(), {*spark.sparkContext.statusTracker().getJobIdsForGroup()}
    found = learning._settled_centres(at.select("x", "y"), starts)
    got = learning._silhouettes(at.select("x", "y"), found)
    # rounds of all numbers share their jobs: 20 rounds and two more passes, two jobs each where Spark plans a shuffle first
    assert len({*tracker.getJobIdsForGroup()} - before) <= 2 * 22
    assert all(found[n] == pytest.approx(c, abs=1e-6) for n, c in centres.items()) and got == {n: pytest.approx(s, abs=1e-6) for n, s in enumerate(scores, 2)}
    best = fits[int(np.argmax(scores))]
    want = sorted(map(tuple, best.clusterCenters()))
    areas = learning.joint_areas(df, most=8).collect()
    assert len(areas) == 600 and sorted({(r.cx, r.cy) for r in areas}) == [pytest.approx(c, abs=1e-6) for c in want]
    assert all(r.aoi == "ABCDEFGH"[min(range(len(want)), key=lambda c: (rows[r.k][2] - want[c][0]) ** 2 + (rows[r.k][3] - want[c][1]) ** 2)] for r in areas)


def test_kernel_machines_share_passes_and_reach_the_loss_of_single_fits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    y = 1.0 + (np.hypot(*x.T) > 1.1) + (np.hypot(*x.T) > 1.8)
    df = spark.createDataFrame([(1, k, p.tolist(), float(c)) for k, (p, c) in enumerate(zip(x, y, strict=True))], "recording_id long, i long, f array<double>, label double").withColumn("vector", array_to_vector("f")).repartition(3).persist()
    tracker = spark.sparkContext.statusTracker()
    before = {*tracker.getJobIdsForGroup()}
    model = learning.KernelMachine(2, gamma=1.0, size=60).fit(df, rounds=20)
    # three machines of 20 rounds and the moments: a pass a round, two jobs where Spark plans a shuffle first
    assert len({*tracker.getJobIdsForGroup()} - before) <= 2 * 22 + 8
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    f = learning.fourier_features(z, model.directions, model.phases)
    sd = f.std(0, ddof=1)
    lifted = spark.createDataFrame([(p.tolist(), float(c)) for p, c in zip(f, y, strict=True)], "f array<double>, label double").withColumn("lifted", array_to_vector("f")).persist()

    def loss(w, b, c):
        return np.maximum(0, 1 - np.where(y == c, 1, -1) * (f @ w + b)).mean() + 0.5e-4 * ((w * sd) ** 2).sum()

    for c, weights, said in zip(model.labels, model.weights, model.loss, strict=True):
        single = LinearSVC(maxIter=20, regParam=1e-4, featuresCol="lifted", labelCol="own").fit(lifted.withColumn("own", (F.col("label") == float(c)).cast("double")))
        assert loss(weights[:-1], weights[-1], c) == pytest.approx(said, abs=1e-9)
        assert said <= loss(single.coefficients.toArray(), single.intercept, c) * 1.05 + 1e-3
