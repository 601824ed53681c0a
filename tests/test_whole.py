"""Registered queries and operators do the whole job: no prefixes, neighbours only, first matches or top few."""

import duckdb
import numpy as np

from gazeloom.operators import aois
from gazeloom.operators import kernels as K
from gazeloom.plans import catalog, kernels


def test_common_patterns_read_whole_sequences(spark, sf):
    co = kernels._of(aois.collapse(catalog.SEQ, "seq", "co"), "co", spark, sf).toPandas()
    got = {r.panel: (r.emine, r.cdba) for r in kernels.QUERIES["aoi_common_patterns"](spark, sf).collect()}
    assert co.k.max() >= 20
    for panel, g in co.groupby(co.recording_id // 5):
        seqs = [list(r.sort_values("k").aoi) for _, r in g.groupby("recording_id", sort=True)]
        assert got[panel] == ("".join(K.emine(seqs)), "".join(K.cdba(seqs)))


def test_pairwise_queries_take_all_pairs(spark, sf):
    ids = sorted(r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").count().where("count > 1").collect())
    want = [(a, b) for a in ids for b in ids if a < b]
    for name in ("cross_recurrence", "eye_analysis_distance", "time_delay_embedding", "subsmatch_similarity", "cross_spectra", "scanpath_similarity", "aoi_edit_distances"):
        assert sorted((r.id_1, r.id_2) for r in kernels.QUERIES[name](spark, sf).select("id_1", "id_2").distinct().collect()) == want, name


def test_learning_labels_all_recordings(spark, sf):
    got = kernels.QUERIES["learn_forest"](spark, sf).select("recording_id", "i", "training").collect()
    assert len(got) == kernels.gaze(spark, sf).count()
    assert all(r.training == (r.recording_id % 2 == 0) for r in got) and len({r.training for r in got}) == 2


def _same_as_duckdb(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    rows = sorted(tuple(map(str, r)) for r in got.collect())
    assert rows == sorted(tuple(map(str, r)) for r in con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    return got


def test_asof_takes_all_events_as_second_stream(spark, sf):
    got = _same_as_duckdb(spark, sf, "asof_nearest")
    assert {r.v % 3 for r in got.select("v").where("v IS NOT NULL").collect()} == {0, 1, 2}


def test_pursuit_target_is_as_long_as_each_recording(spark, sf):
    _same_as_duckdb(spark, sf, "pursuit_task")
    target = catalog.PLANS["pursuit_task"].steps["target"]
    plan = catalog.Plan({k: v for k, v in catalog.PLANS["pursuit_task"].steps.items() if k in ("gaze", "good")}).then("target", target)
    assert plan.spark(spark, events=spark.read.parquet(f"{sf}/events.parquet")).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_chance_level_and_rounds_of_the_reference():
    rng = np.random.default_rng(0)
    s, t = rng.uniform(0, 100, (9, 3)), rng.uniform(0, 100, (7, 3))
    assert kernels.METRICS["mannan"](s, t) == K.mannan(s, t, catalog.WIDTH, catalog.HEIGHT, 1000)
    assert kernels.METRICS["mannan"](s, t) != K.mannan(s, t, catalog.WIDTH, catalog.HEIGHT, 20)
    pts = rng.uniform(0, 1, (60, 2)) * (500, 100)
    assert (K.affinity_propagation(pts) == K.affinity_propagation(pts, rounds=1000)).all()
    assert K.affinity_propagation.__defaults__[1] == 1000
