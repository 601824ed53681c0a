"""Pairs by blocks, near pairs, and what all recordings have in common, against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators import batches, common, grouped, pairwise
from gazeloom.operators import kernels as K


@pytest.fixture(scope="module")
def paths(spark):
    rng = np.random.default_rng(2)
    made = {int(i): rng.uniform(0, 100, (int(n), 2)) for i, n in zip(rng.choice(10**6, 30, False), rng.integers(1, 30, 30), strict=True)}
    rows = [(i, k, float(x), float(y), 1.0) for i, p in made.items() for k, (x, y) in enumerate(p)]
    return made, spark.createDataFrame(rows, "recording_id long, k long, x double, y double, dur double").repartition(4)


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_each_pair_once_and_each_recording_once_a_block(spark, paths, blocks):
    made, df = paths
    packed = pairwise.pack_points(df)
    dealt = pairwise.dealt(packed, blocks).groupBy("recording_id").count().collect()
    assert {r["count"] for r in dealt} == {blocks}
    kernel = lambda one, v, ids, vs: ((one, int(i), float(v.sum() + w.sum())) for i, w in zip(ids, vs, strict=True))
    got = sorted(map(tuple, pairwise.compare(packed, kernel, "id_1 long, id_2 long, s double", blocks=blocks).collect()))
    assert [r[:2] for r in got] == sorted(combinations(sorted(made), 2))
    assert all(s == pytest.approx(made[a].sum() + made[b].sum()) for a, b, s in got)


def test_blocks_follow_the_size(spark, paths, monkeypatch):
    packed = pairwise.pack_points(paths[1])
    few = pairwise.blocks_for(packed, "v")
    monkeypatch.setattr(pairwise, "BLOCK_BYTES", 200)
    assert few < pairwise.blocks_for(packed, "v") == -(-8 * 2 * sum(map(len, paths[0].values())) // 200)
    assert pairwise.compare(packed.limit(0), pairwise.point_mapping, pairwise.POINT_MAPPING).count() == 0


def test_chunks_of_partners_change_nothing(paths, monkeypatch):
    made, _ = paths
    one, *rest = made.items()
    args = (one[0], one[1].ravel(), np.array([i for i, _ in rest]), [p.ravel() for _, p in rest])
    kernels = (pairwise.cross_recurrence(15.0, 2), pairwise.point_mapping, pairwise.time_delay_embedding(3))
    whole = [list(k(*args)) for k in kernels]
    monkeypatch.setattr(pairwise, "CELLS", 40)
    assert repr([list(k(*args)) for k in kernels]) == repr(whole) and all(whole)


def test_given_pairs_equal_all_pairs(spark, paths):
    made, df = paths
    metrics = {"dtw": K.dtw, "multimatch": lambda s, t: K.multimatch(s, t, 140.0)}
    every = {(r.id_1, r.id_2, r.metric): r.value for r in grouped.pair_metrics(df, metrics).collect()}
    asked = [p for n, p in enumerate(combinations(sorted(made), 2)) if n % 20 == 0]
    some = grouped.pair_metrics(df, metrics, pairs=spark.createDataFrame(asked, "id_1 long, id_2 long")).collect()
    assert len(every) == 435 * 6 and len(some) == len(asked) * 6
    assert all(repr(every[r.id_1, r.id_2, r.metric]) == repr(r.value) for r in some)


@pytest.mark.parametrize("kind", ["dtw", "frechet"])
def test_near_pairs_are_those_below_the_limit(paths, kind):
    made, df = paths
    whole = {(a, b): (K.dtw if kind == "dtw" else K.discrete_frechet)(made[a], made[b]) for a, b in combinations(sorted(made), 2)}
    limit = float(np.quantile(list(whole.values()), 0.2))
    got = {(r.id_1, r.id_2): r.distance for r in pairwise.compare(pairwise.pack_points(df), pairwise.near_pairs(limit, kind), pairwise.NEAR).collect()}
    assert got == {k: pytest.approx(d) for k, d in whole.items() if d <= limit} and got


def _sequences(spark, rng, n, symbols="ABCDE", start=0):
    made = {start + i: list(rng.choice(list(symbols), rng.integers(4, 18))) for i in range(n)}
    return made, spark.createDataFrame([(i, k, a) for i, s in made.items() for k, a in enumerate(s)], "recording_id long, k long, aoi string").repartition(3)


def test_common_subsequence_of_all_recordings(spark):
    rng = np.random.default_rng(3)
    made, df = _sequences(spark, rng, 40)
    distinct = sorted({tuple(s) for s in made.values()}, key=lambda s: (len(s), s))
    assert common.common_subsequence(df).first().pattern == K.emine([list(s) for s in distinct])
    # a tree of merges keeps to what all sequences hold
    made = {i: [x for c in "CDCD" for x in [*rng.choice(list("AB"), rng.integers(0, 4)), c]] for i in range(150)}
    df = spark.createDataFrame([(i, k, a) for i, s in made.items() for k, a in enumerate(s)], df.schema)
    got = common.common_subsequence(df, leaf=8).collect()
    assert len(got) == 1 and got[0].length == len(got[0].pattern) > 0
    assert all(all(x in it for x in got[0].pattern) for s in made.values() for it in [iter(s)])
    assert common.common_subsequence(df.limit(0)).count() == 0


def test_barycentre_equals_the_kernel(spark):
    rng = np.random.default_rng(4)
    made, df = _sequences(spark, rng, 40)
    first = pairwise.pack_symbols(df).selectExpr("min_by(v, struct(xxhash64(1, recording_id), recording_id)) AS v").first().v
    got, rounds = common.barycentre(df)
    assert got == K.cdba(list(made.values()), start=first) and 1 <= rounds <= 20
    assert common.barycentre(df.limit(0)) == ([], 0)


def _greedy_tree(made):
    score = {(a, b): len(K.longest_common_subsequence(made[a], made[b])) for a, b in combinations(sorted(made), 2)}
    total = Counter()
    for (a, b), s in score.items():
        total[a] += s
        total[b] += s
    alive, out = set(made), []
    while True:
        left = [(-s, a, b) for (a, b), s in score.items() if a in alive and b in alive and s]
        if not left:
            return out
        s, a, b = min(left)
        kept, gone = (a, b) if total[a] > total[b] else (b, a)
        out.append((kept, gone, -s))
        alive.remove(gone)


def test_likeness_tree_equals_greedy_merges(spark):
    made, df = _sequences(spark, np.random.default_rng(5), 35)
    made |= {900: list("ZZY"), 901: list("QZ"), 902: list("W")}
    df = df.unionByName(spark.createDataFrame([(i, k, a) for i in (900, 901, 902) for k, a in enumerate(made[i])], df.schema))
    got = [tuple(r) for r in common.likeness_tree(df).collect()]
    want = _greedy_tree(made)
    assert sorted(got) == sorted(want) and len(want) == 35
    letters = dict(zip("123456", ("XMJYXUZ", "MZJXJYAWXU", "MZJAJYYAWXU", "AWXJYAW", "MZJAWXU", "XMJYAUZ"), strict=True))
    assert [[common._common_length(list(a), list(b)) for b in letters.values()] for a in letters.values()] == [[len(K.longest_common_subsequence(a, b)) for b in letters.values()] for a in letters.values()]
    assert [common._common_length(list(letters["1"]), list(b)) for b in letters.values()] == [7, 5, 5, 3, 4, 6]


def test_shared_ngrams_are_looked_up_not_compared_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    made = {i: list(rng.choice(["a", "b", "cd"], n)) for i, n in enumerate([0, 1, 2, 3, 3, 4, 9, 25, 40, 2, 60])}
    made[11] = list(made[8])
    table = {i: Counter(tuple(s[k : k + 3]) for k in range(len(s) - 2)) for i, s in made.items()}
    share = {i: {g: n / sum(c.values()) for g, n in c.items()} for i, c in table.items()}
    want = {(a, b): 1 - 0.5 * sum(abs(share[a].get(g, 0) - share[b].get(g, 0)) for g in {*share[a], *share[b]}) for a, b in combinations(made, 2) if share[a] or share[b]}
    packed = spark.createDataFrame(list(made.items()), "recording_id long, v array<string>")
    for blocks in (1, 3):
        got = {(r.id_1, r.id_2): r.similarity for r in pairwise.compare(packed, pairwise.SubsequenceSimilarity(), pairwise.SUBSEQUENCES, blocks=blocks).collect()}
        assert got == {k: pytest.approx(x, abs=1e-6) for k, x in want.items()} and got[8, 11] == 1.0
    pairs = spark.createDataFrame([(0, 8), (3, 4), (8, 11), (0, 9)], "id_1 long, id_2 long")
    some = {(r.id_1, r.id_2): r.similarity for r in pairwise.given(packed, pairs, pairwise.SubsequenceSimilarity(), pairwise.SUBSEQUENCES).collect()}
    assert some == {p: got[p] for p in [(0, 8), (3, 4), (8, 11)]}
    # one call for all partners, with columns instead of a row a pair
    kernel = pairwise.SubsequenceSimilarity()
    at = kernel.start([np.array(s, object) for s in made.values()])
    (rows,) = kernel(8, at[8], np.array(list(made))[9:], at[9:])
    assert isinstance(rows, pairwise.Columns) and len(rows[1]) == 3


def test_merges_need_no_tables_of_edit_distances(monkeypatch):
    rng = np.random.default_rng(9)
    made = [list(rng.choice(list("ABCDE"), n)) for n in [0, 1, 1, 2, 5, 30, 63, 64, 65, 66, 130, 200]]
    assert all(K.edit_distance(a, b) == K.weighted_levenshtein(a, b) for a in made for b in made)
    few = [list(rng.choice(list("ABC"), rng.integers(5, 30))) for _ in range(15)]
    with monkeypatch.context() as m:
        m.setattr(K, "edit_distance", K.weighted_levenshtein)
        want = K.emine(few)
    monkeypatch.setattr(K, "_edit_table", None)
    assert K.emine(few) == want and K.emine([]) == []


def test_likeness_tree_keeps_no_pairs_and_follows_blocks_of_falling_sums(spark, monkeypatch):
    rng = np.random.default_rng(10)
    made, _ = _sequences(spark, rng, 60, "ABC", start=2**60)
    # copies with small ids, whose scores tie, and one of several words
    made |= {i: list("ABCAB") for i in range(40)} | {50: list(rng.choice(list("AB"), 150)), 51: list("Z")}
    df = spark.createDataFrame([(i, k, a) for i, s in made.items() for k, a in enumerate(s)], "recording_id long, k long, aoi string")
    # neither a table of all pairs nor rounds of mutual best ones: copies merge one at a time in these
    monkeypatch.setattr(common, "likeness", None)
    want = sorted(_greedy_tree(made))
    for size in (4096, 25):
        tree = common.likeness_tree(df, size=size)
        assert sorted(map(tuple, tree.collect())) == want and tree.dtypes == [("kept", "bigint"), ("gone", "bigint"), ("score", "int")]
    assert common.likeness_tree(df.limit(0)).count() == 0


def test_common_lengths_of_many_sequences_at_once():
    rng = np.random.default_rng(11)
    made = [list(rng.choice(list("ABCD"), n)) for n in [0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 192, 193, 257, 300]] + [["A"] * 130, ["A"] * 200]
    code = batches.coded(made)
    assert batches.common_lengths(code)(code).tolist() == [[common._common_length(a, b) for b in made] for a in made]
    assert batches.common_lengths(code[:3])([*code, np.array([77])]).shape == (len(made) + 1, 3)


def test_path_measures_take_all_partners_at_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    plane = (500.0, 100.0, (500.0**2 + 100.0**2) ** 0.5)
    made = {i: np.stack([rng.uniform(0, 520, n), rng.integers(0, 100, n), rng.exponential(1e5, n)], 1) for i, n in enumerate([1, 1, 2, 3, 5, 30, 30, 47, 48, 70, 90])}
    # a copy, and points that MultiMatch drops
    made |= {20: made[7].copy(), 21: np.array([[5.0, 5, 0.1], [5, 5, 0.1], [6, 5, 0.1]])}
    df = spark.createDataFrame([(i, k, *map(float, p)) for i, path in made.items() for k, p in enumerate(path)], "recording_id long, k long, x double, y double, dur double")
    metrics = grouped.path_metrics(*plane, step=1e5, rounds=20)
    want = {}
    for a, b in combinations(made, 2):
        for name, fn in metrics.items():
            got = fn(made[a], made[b])
            want |= {(a, b, name if k is None else f"{name}_{k}"): x for k, x in (got.items() if isinstance(got, dict) else [(None, got)])}
    for name in ("dtw", "discrete_frechet", "multimatch", "scanmatch", "mannan", "_warp_table"):
        monkeypatch.setattr(K, name, None)
    got = {(r.id_1, r.id_2, r.metric): r.value for r in grouped.pair_metrics(df, metrics).collect()}
    missing = {k for k, x in want.items() if x != x}
    assert got.keys() == want.keys() and missing == {k for k, x in got.items() if x is None} and missing
    assert all(got[k] == pytest.approx(x, rel=1e-9, abs=1e-9) for k, x in want.items() if k not in missing)
    # no kernel of one pair in the batch either, which the tasks' own modules would not show
    kernel = batches.PathMeasures(**metrics.parameters)
    vs = kernel.start([p.ravel() for p in made.values()])
    (rows,) = kernel(20, vs[-2], np.array(list(made)), vs)
    assert isinstance(rows, batches.Columns) and len(rows[3]) == 9 * len(made)


def test_chances_of_random_scanpaths_are_drawn_as_before():
    for n, m in [(1, 1), (3, 17), (40, 33)]:
        rng = np.random.default_rng(0)
        drawn = [K._mannan_distance(rng.uniform(0, 1, (n, 2)) * (500.0, 100.0), rng.uniform(0, 1, (m, 2)) * (500.0, 100.0), 500.0, 100.0) for _ in range(50)]
        assert K.mannan_chance(n, m, 500.0, 100.0, 50, 0) == float(np.mean(drawn))


def test_equal_scanpaths_are_mapped_once_and_stay_together(spark, paths):
    made, _ = paths
    base = list(made.values())[:6]
    many = {100 * i + n: p for i in range(8) for n, p in enumerate(base)} | {7000 + n: p for n, p in enumerate(list(made.values())[6:9])}
    packed = spark.createDataFrame([(i, [float(z) for z in p.ravel()]) for i, p in many.items()], "recording_id long, v array<double>").repartition(3)
    want = {}
    for a, b in combinations(sorted(many), 2):
        d = np.hypot(many[a][:, None, 0] - many[b][:, 0], many[a][:, None, 1] - many[b][:, 1])
        n, m = d.shape
        want[a, b] = ((d.min(0).sum() + d.min(1).sum()) / max(n, m), np.sqrt((m * (d.min(1) ** 2).sum() + n * (d.min(0) ** 2).sum()) / (2 * n * m)))
    for blocks in (1, 4):
        got = {(r.id_1, r.id_2): r[2:] for r in pairwise.compare(packed, pairwise.PointMapping(), pairwise.POINT_MAPPING, blocks=blocks).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(x, abs=2e-6) for k, x in want.items())
    # each pair of different scanpaths is compared once a task: nothing new for a copy
    kernel = pairwise.PointMapping()
    at = kernel.start([p.ravel() for p in many.values()])
    assert sorted(set(at.tolist())) == list(range(9))
    list(kernel(0, at[0], np.array(list(many))[1:], at[1:]))
    kernel.paths = [None] * 9
    (rows,) = kernel(100, at[6], np.array(list(many))[7:], at[7:])
    assert len(rows[2]) == len(many) - 7 and rows[2][5] == 0.0
    # copies of one scanpath are no larger block than others
    same = packed.withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    sizes = [r["count"] for r in pairwise.dealt(same, 4, "v").where("low = high").groupBy("low").count().collect()]
    assert sum(sizes) == len(many) and len(sizes) == 4 and max(sizes) < len(many) / 2


def test_equal_recordings_are_compared_once(spark):
    rng = np.random.default_rng(3)
    paths = [np.round(rng.uniform(0, 100, 2 * n), 3) for n in rng.integers(1, 9, 7)]
    names = [[chr(65 + c) for c in rng.integers(0, 3, n)] for n in rng.integers(1, 9, 7)]
    points = spark.createDataFrame([(k, paths[k % 7].tolist()) for k in range(42)], "recording_id long, v array<double>")
    symbols = spark.createDataFrame([(k, names[k % 7]) for k in range(42)], "recording_id long, v array<string>")
    calls = spark.sparkContext.accumulator(0)

    def counted(kernel):
        class Counted:
            def start(self, values):
                return kernel.start(values) if hasattr(kernel, "start") else values

            def __call__(self, one, v, ids, vs):
                calls.add(len(ids))
                yield from kernel(one, v, ids, vs)

        return Counted()

    def rows(values, kernel, schema, blocks):
        return sorted(repr(tuple(r)) for r in pairwise.compare(values, kernel, schema, blocks=blocks).collect())

    def single(values, kernel, schema):
        arrow = pairwise._arrow_schema(T._parse_datatype_string(schema))
        found = pairwise._each(kernel, np.arange(42), np.zeros(42), [values[k % 7] for k in range(42)], True)
        return sorted(repr(tuple(r.values())) for c in (row if isinstance(row, batches.Columns) else batches.Columns((row[0], np.array([row[1]]), *row[2:])) for row in found) for b in pairwise._batches(c, arrow) for r in b.to_pylist())

    def plain(one, v, ids, vs):
        for two, w in zip(ids.tolist(), vs, strict=True):
            yield one, two, float(abs(v.sum() - w.sum()))

    kinds = [
        (points, pairwise.joint_bins(4, 4), pairwise.JOINT_BINS), (points, pairwise.cross_recurrence(40.0), pairwise.CROSS_RECURRENCE), (points, pairwise.time_delay_embedding(3), pairwise.TIME_DELAY),
        (points, pairwise.near_pairs(60.0), pairwise.NEAR), (points, batches.WarpLinks("frechet"), "id_1 long, id_2 long, distance double, left array<int>, right array<int>"), (points, batches.CrossSpectra(1.0, 4), "id_1 long, id_2 long, cell long, frequency double, re double, im double, coherency double"),
        (symbols, batches.Alignments(), "id_1 long, id_2 long, score double, aligned array<string>"), (points, plain, pairwise.NEAR),
    ]
    for values, kernel, schema in kinds:
        want = single(paths if values is points else [np.array(v, object) for v in names], kernel, schema)
        assert want and rows(values, kernel, schema, 2) == want == rows(values, kernel, schema, 1)
    pairwise.compare(points, counted(pairwise.joint_bins(4, 4)), pairwise.JOINT_BINS, blocks=1).count()
    # seven kinds, each way; 861 pairs
    assert 0 < calls.value <= 49
