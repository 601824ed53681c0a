"""Relational queries: each plan runs on Spark and, as the same text in the other dialect, in DuckDB."""

from __future__ import annotations

from ..functions import kinematics as kin
from ..functions.relational import Plan, r6
from ..operators import aois, events, islands, scanpaths, segmentation, signals

FS, WIDTH, HEIGHT = 1.0, 500.0, 100.0
#: Thresholds for gaze made of events: steps of the plane per sample.
SLOW, FAST = 120.0, 250.0
RADIUS = 0.1 * (WIDTH**2 + HEIGHT**2) ** 0.5

#: Named before any window, so that Spark sees one partitioning all the way up.
_SOURCE = "(SELECT user_id AS recording_id, ts, event_id, event_type, value AS x, CAST(@json_k(props) AS DOUBLE) AS y FROM {events}) s"
GAZE = Plan().then(
    "gaze",
    f"""SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, x, y,
    CAST(600 AS DOUBLE) AS z, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS status FROM {_SOURCE}""",
)
GOOD = GAZE.then("good", "SELECT recording_id, i, x, y, z, CAST(1 AS DOUBLE) AS status FROM gaze")
KIN = kin.kinematics(GOOD, "good", "kin", FS, WIDTH, HEIGHT)
PATH = Plan().then(
    "seq0",
    f"""SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY ts, event_id) - 1 AS BIGINT) AS k, x, y, event_type,
    (lead(@micros(ts)) OVER (PARTITION BY recording_id ORDER BY ts, event_id) - @micros(ts)) / 1e6 AS dur FROM {_SOURCE}""",
).then("path", "SELECT recording_id, k, x, y, dur, CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'E' END AS aoi FROM seq0 WHERE dur IS NOT NULL")
#: Blocks of recordings, and tasks that the pairs of blocks are dealt to (a hint to Spark, a comment elsewhere).
BLOCKS, PAIR_TASKS = 32, 256
#: Pairs of recordings for pairwise operators: all with id_1 < id_2. Each recording goes to every pair of its block with another, so two recordings meet in one cell only.
PAIRS = (
    PATH.then("ids", f"SELECT recording_id, ((recording_id % {BLOCKS}) + {BLOCKS}) % {BLOCKS} AS mine FROM (SELECT DISTINCT recording_id FROM path) q")
    .then("blocks", f"SELECT @upto({BLOCKS}) AS c")
    .then("dealt", "SELECT recording_id, mine, c - 1 AS other FROM ids CROSS JOIN blocks")
    .then("pairs", f"SELECT /*+ REPARTITION({PAIR_TASKS}, id_1, id_2) */ id_1, id_2 FROM (SELECT a.recording_id AS id_1, b.recording_id AS id_2 FROM dealt a JOIN dealt b ON a.mine = b.other AND a.other = b.mine AND a.recording_id < b.recording_id) q")
)
SEQ = PATH.then("seq", "SELECT recording_id, k, aoi, dur FROM path")


def _r(*columns: str) -> str:
    return ", ".join(f"{r6(c)} AS {c}" for c in columns)


def _fixations(p: Plan, kind: str = "euclidean") -> Plan:
    p = segmentation.ivt(p, "kin", "lab", SLOW, FS, min_fix=1.0, max_fix=1000.0, min_sac=0.0)
    return events.event_table(p, "lab", "label = 1", "fix", FS, "label > 0", kind=kind)


def _saccades(p: Plan, kind: str = "euclidean") -> Plan:
    p = segmentation.ivt(p, "kin", "lab", SLOW, FS, min_fix=1.0, max_fix=1000.0, min_sac=0.0)
    return events.saccade_columns(events.event_table(p, "lab", "label = 2", "sac0", FS, "label > 0", kind=kind), "sac0", "sac")


def _pursuits(p: Plan) -> Plan:
    p = segmentation.ivvt(p, "kin", "v3", FAST, SLOW)
    p = segmentation.three_class(p, "v3", "lab", FS, (1.0, 1000.0), (1.0, 1000.0))
    return islands.with_runs(p, "lab", "lab_r", "label", "lr").then("lab_s", "SELECT *, a_lr AS a, b_lr AS b FROM lab_r")


def _plans() -> dict[str, Plan]:
    q: dict[str, Plan] = {}
    q["kinematics"] = KIN.then("out", f"SELECT recording_id, i, {_r('ux', 'uy', 'uz', 'theta_x', 'theta_y', 'speed_angular', 'speed', 'vx', 'vy', 'vz')} FROM kin")
    q["pairwise_distances"] = KIN.then("out", f"SELECT recording_id, i, {r6('degrees(acos(greatest(-1.0, least(1.0, (x * lx + y * ly + z * lz) / (sqrt(x * x + y * y + z * z) * sqrt(lx * lx + ly * ly + lz * lz))))))')} AS angular, {r6('sqrt(power(x - lx, 2) + power(y - ly, 2) + power(z - lz, 2))')} AS euclidean FROM (SELECT *, lag(x) OVER ({kin.W}) AS lx, lag(y) OVER ({kin.W}) AS ly, lag(z) OVER ({kin.W}) AS lz FROM kin) q WHERE lx IS NOT NULL")
    q["smoothing_moving_average"] = kin.moving_average(GOOD, "good", "ma", 5).then("out", f"SELECT recording_id, i, {_r('s_x', 's_y')} FROM ma")
    q["smoothing_speed_average"] = kin.speed_moving_average(GOOD, "good", "sm", 5, FS).then("out", f"SELECT recording_id, i, {_r('s_x', 's_y')} FROM sm")
    q["smoothing_savgol"] = kin.savgol(GOOD, "good", "sg", 9, 3).then("out", f"SELECT recording_id, i, {_r('s_x', 's_y')} FROM sg")
    q["clean_signal"] = kin.clean_signal(GAZE, "gaze", "cl").then("out", f"SELECT recording_id, i, {_r('x')} FROM cl")
    q["clean_signal_limited"] = kin.clean_signal(GAZE, "gaze", "cl", max_gap=1).then("out", f"SELECT recording_id, i, {_r('x')} FROM cl")
    q["normalised"] = kin.normalised(GOOD, "good", "nm", "x").then("out", f"SELECT recording_id, i, {_r('z')} FROM nm")
    bins = kin.spatial_bins(PATH, "path", "bins", 10, 10, WIDTH, HEIGHT)
    q["spatial_bins"] = bins.then("out", "SELECT recording_id, k, gx, gy, concat(@letter(gy), @letter(gx)) AS symbol FROM bins")
    q["spatial_temporal_bins"] = bins.then("rep", "SELECT recording_id, k, gx, gy, @upto(ceil(dur / 20000.0)) AS r FROM bins").then("out", "SELECT recording_id, k, concat(@letter(gy), @letter(gx)) AS symbol, count(*) AS repeats FROM rep GROUP BY recording_id, k, gy, gx")
    # how far the next fixation is on the grid, and where the visited cells lie
    steps = kin.bin_distances(bins, "bd", 10, 10, WIDTH, HEIGHT).then("steps", "SELECT recording_id, gx1, gy1, gx2, gy2, count(*) AS n FROM (SELECT recording_id, gx AS gx1, gy AS gy1, lead(gx) OVER (PARTITION BY recording_id ORDER BY k) AS gx2, lead(gy) OVER (PARTITION BY recording_id ORDER BY k) AS gy2 FROM bins) q WHERE gx2 IS NOT NULL GROUP BY recording_id, gx1, gy1, gx2, gy2")
    q["bin_distances"] = steps.then("out", f"SELECT s.recording_id, s.gx1, s.gy1, s.gx2, s.gy2, s.n, {r6('d.distance')} AS distance FROM steps s JOIN bd d ON d.gx1 = s.gx1 AND d.gy1 = s.gy1 AND d.gx2 = s.gx2 AND d.gy2 = s.gy2")
    visited = kin.bin_corners(bins, "bc", 10, 10, WIDTH, HEIGHT).then("visited", "SELECT recording_id, concat(@letter(gy), @letter(gx)) AS symbol, count(*) AS n FROM bins GROUP BY recording_id, gy, gx")
    q["bin_corners"] = visited.then("out", f"SELECT v.recording_id, v.symbol, v.n, {_r('x', 'y')} FROM visited v JOIN bc c ON c.symbol = v.symbol")
    # runs and filters
    q["interval_merging"] = islands.runs(GOOD, "good", "rn", "x <= 100", 1).then("out", "SELECT recording_id, k, a, b, b - a + 1 AS n FROM rn")
    q["interval_status"] = islands.runs(GAZE, "gaze", "rn", "x <= 300", 1, 50, 0.7).then("out", "SELECT recording_id, k, a, b FROM rn")
    two = segmentation.ivt(KIN, "kin", "lab", SLOW, FS, min_fix=1.0, max_fix=1000.0, min_sac=0.0)
    q["binary_duration_filter"] = islands.duration_filter(two, "lab", "df", FS, {1: (3.0, 10.0)}).then("out", "SELECT recording_id, label, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM df GROUP BY recording_id, label")
    q["interval_centroids"] = islands.run_samples(GOOD, "good", "sm", "x <= 150", 1).then("out", f"SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a) - 1 AS BIGINT) AS k, {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy, {r6('max(x) - min(x) + max(y) - min(y)')} AS dispersion FROM sm GROUP BY recording_id, a")
    # segmentation
    q["ivt"] = two.then("out", "SELECT recording_id, i, label FROM lab")
    q["ivt_angular"] = segmentation.ivt(KIN, "kin", "lab", 12.0, FS, "speed_angular", min_fix=1.0, max_fix=1000.0, min_sac=0.0).then("out", "SELECT recording_id, i, label FROM lab")
    q["ivvt"] = segmentation.three_class(segmentation.ivvt(KIN, "kin", "v3", FAST, SLOW), "v3", "lab", FS, (1.0, 1000.0), (1.0, 1000.0)).then("out", "SELECT recording_id, i, label, event FROM lab")
    q["ivmp"] = segmentation.three_class(segmentation.ivmp(KIN, "kin", "v3", FAST, 0.5, 4.0, FS), "v3", "lab", FS, (1.0, 1000.0), (1.0, 1000.0)).then("out", "SELECT recording_id, i, label FROM lab")
    q["ibdt"] = segmentation.three_class(segmentation.ibdt(KIN, "kin", "v3", 5.0, 50.0, 120.0, 300.0, 40.0, FS), "v3", "lab", FS, (1.0, 1000.0), (1.0, 1000.0)).then("out", "SELECT recording_id, i, label FROM lab")
    # events
    fix, sac = _fixations(KIN), _saccades(KIN)
    q["fixation_events"] = fix.then("out", f"SELECT recording_id, k, a, b, n, {_r('duration', 'cx', 'cy', 'mean_speed', 'sd_speed', 'displacement', 'path', 'bcea')} FROM fix")
    q["fixation_metrics"] = events.per_recording(fix, "fix", "out", FS, [m.replace("{fs}", str(FS)) for m in events.FIXATION])
    q["fixation_durations"] = fix.then("out", f"SELECT recording_id, count(*) AS n, {events.mean_sd('duration', 'duration')} FROM fix GROUP BY recording_id")
    q["saccade_events"] = sac.then("out", f"SELECT recording_id, k, a, b, n, {_r('duration', 'displacement', 'amplitude3', 'path', 'direction', 'initial_direction', 'max_curvature', 'area_curvature', 'peak', 'mean_acc', 'mean_up', 'mean_down', 'successive')}, peak_i FROM sac")
    q["saccade_metrics"] = events.per_recording(sac, "sac", "out", FS, events.SACCADE)
    pur = events.event_table(_pursuits(KIN), "lab_s", "label = 3", "pur", FS)
    q["pursuit_events"] = pur.then("out", f"SELECT recording_id, k, a, b, n, {_r('duration', 'mean_speed', 'peak', 'displacement', 'path')} FROM pur")
    q["pursuit_metrics"] = events.per_recording(pur, "pur", "out", FS, events.PURSUIT)
    # distances as visual angles
    q["fixation_metrics_angular"] = events.per_recording(_fixations(KIN, "angular"), "fix", "out", FS, [m.replace("{fs}", str(FS)) for m in events.FIXATION])
    q["saccade_metrics_angular"] = events.per_recording(_saccades(KIN, "angular"), "sac", "out", FS, events.SACCADE)
    q["pursuit_metrics_angular"] = events.per_recording(events.event_table(_pursuits(KIN), "lab_s", "label = 3", "pur", FS, kind="angular"), "pur", "out", FS, events.PURSUIT)
    target = _pursuits(KIN).then("target", "SELECT recording_id, i, 250 + 200 * sin(i / 5.0) AS x, 50 + 40 * cos(i / 5.0) AS y FROM good")
    q["pursuit_task"] = events.pursuit_task(target, "lab", "target", "label = 3", "out", FS, 5, 40.0, 0.5)
    q["pursuit_task_angular"] = events.pursuit_task(target, "lab", "target", "label = 3", "out", FS, 5, 40.0, 0.5, "angular")
    error = KIN.then("err", "SELECT recording_id, i, vx - 40 * cos(i / 5.0) AS e FROM kin")
    q["pursuit_task_entropy"] = events.approximate_entropy(error, "err", "out", 2, 150.0)
    # scanpaths
    q["scanpath_from_fixations"] = scanpaths.from_fixations(fix, "fix", "sp").then("out", f"SELECT recording_id, k, {_r('x', 'y', 'dur')} FROM sp")
    mapped_gaze = fix.then("mapped_gaze", "SELECT recording_id, i, 1.1 * x + 0.2 * y - 20 AS ref_x, 0.9 * y - 0.01 * x + 3 AS ref_y, CASE WHEN i % 7 = 3 THEN 0.0 ELSE 1.0 END AS status FROM good")
    q["scanpath_from_mapped_gaze"] = scanpaths.from_mapped_gaze(mapped_gaze, "fix", "mapped_gaze", "sp", WIDTH, HEIGHT).then("out", f"SELECT recording_id, k, {_r('x', 'y', 'dur')} FROM sp")
    q["scanpath_geometry"] = scanpaths.geometry(PATH, "path", "out")
    q["recurrence"] = scanpaths.recurrence(PATH, "path", "out", RADIUS)
    q["cross_recurrence"] = scanpaths.cross_recurrence(PAIRS, "path", "pairs", "out", RADIUS)
    for kind in ("count", "absolute_duration", "relative_duration"):
        q[f"saliency_{kind}"] = scanpaths.saliency_map(PATH, "path", "sal", WIDTH, HEIGHT, kind).then("out", f"SELECT gx, gy, {r6('v * 1000')} AS v FROM sal")
    odd = PATH.then("path_a", "SELECT * FROM path WHERE recording_id % 2 = 0").then("path_b", "SELECT * FROM path WHERE recording_id % 2 = 1")
    maps = scanpaths.saliency_map(scanpaths.saliency_map(odd, "path_a", "ma", WIDTH, HEIGHT), "path_b", "mb", WIDTH, HEIGHT)
    q["saliency_compare"] = scanpaths.compare_maps(maps, "ma", "mb", "out")
    ref = scanpaths.saliency_map(odd, "path_a", "ma", WIDTH, HEIGHT).then("mr", "SELECT gx, gy, floor(v * 1e9 + 0.5) / 1e9 AS v FROM ma").then("fb", f"SELECT recording_id, CAST(floor(least(x, {WIDTH - 0.001}) / {WIDTH / 25}) AS BIGINT) AS gx, CAST(floor(least(y, {HEIGHT - 0.001}) / {HEIGHT / 25}) AS BIGINT) AS gy FROM path_b")
    q["saliency_reference"] = scanpaths.map_against_fixations(ref, "fb", "mr", "out", 25, 25)
    q["saliency_reference_jitter"] = scanpaths.map_against_fixations(ref, "fb", "mr", "out", 25, 25, jitter=1e-7, seed=1)
    q["saliency_tolerance"] = scanpaths.nss_with_tolerance(ref, "fb", "mr", "out")
    q["pair_bins"] = kin.joint_bins(PAIRS, "path", "pairs", "jb", 8, 8).then("out", "SELECT id_1, id_2, side, gx, gy, count(*) AS n FROM jb GROUP BY id_1, id_2, side, gx, gy")
    q["eye_analysis_distance"] = scanpaths.point_mapping(PAIRS, "path", "pairs", "out")
    q["time_delay_embedding"] = scanpaths.time_delay_embedding(PAIRS, "path", "pairs", "out")
    sym = kin.spatial_bins(PAIRS, "path", "bins", 8, 8, WIDTH, HEIGHT).then("sym", "SELECT recording_id, k, concat(@letter(gy), @letter(gx)) AS s FROM bins")
    q["subsmatch_similarity"] = scanpaths.subsequence_similarity(sym, "sym", "pairs", "out")
    # areas of interest
    rect = PATH.then("rect", " UNION ALL ".join(f"SELECT '{n}' AS aoi, {i} AS idx, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1" for i, (n, x0, y0, x1, y1) in enumerate([("A", 0.0, 0.0, 150.0, 50.0), ("B", 100.0, 20.0, 300.0, 80.0), ("C", 250.0, 0.0, 500.0, 60.0)])))
    q["aoi_predefined"] = aois.predefined(rect, "path", "rect", "pd").then("out", "SELECT recording_id, k, aoi FROM pd")
    q["aoi_predefined_frequent"] = aois.predefined(rect, "path", "rect", "pd", 10).then("out", "SELECT recording_id, k, aoi FROM pd")
    q["aoi_predefined_dwell_time"] = aois.durations(aois.predefined(rect, "path", "rect", "pd"), "pd", "out")
    cent = PATH.then("cent", " UNION ALL ".join(f"SELECT '{n}' AS aoi, {x} AS cx, {y} AS cy" for n, x, y in [("A", 50.0, 20.0), ("B", 200.0, 70.0), ("C", 400.0, 30.0), ("D", 499.0, 99.0)]))
    near = aois.nearest_center(cent, "path", "cent", "nc")
    q["aoi_nearest_center"] = near.then("out", "SELECT recording_id, k, aoi FROM nc")
    middles = PATH.then("middles", "SELECT recording_id, aoi, avg(x) AS cx, avg(y) AS cy FROM path GROUP BY recording_id, aoi")
    q["aoi_center_distances"] = aois.center_distances(middles, "middles", "out")
    q["aoi_merge_small"] = aois.merge_small(near, "nc", "mg", 2000).then("out", "SELECT recording_id, k, aoi FROM mg")
    q["aoi_collapse"] = aois.collapse(SEQ, "seq", "co").then("out", f"SELECT recording_id, k, aoi, {_r('dur')} FROM co")
    q["aoi_temporal_binning"] = aois.temporal_binning(SEQ, "seq", "tb", 50000.0).then("out", f"SELECT recording_id, k, CAST(r AS BIGINT) AS r, aoi, {_r('dur')} FROM tb")
    q["aoi_durations"] = aois.durations(SEQ, "seq", "out")
    q["aoi_bcea"] = aois.bcea(PATH, "path", "out")
    q["aoi_transitions"] = aois.transitions(SEQ, "seq", "tr").then("out", f"SELECT recording_id, src, dst, n, {r6('p')} AS p FROM tr")
    q["aoi_ellipses"] = aois.ellipses(PATH, "path", "out")
    q["aoi_chord_edges"] = aois.chord_edges(aois.transitions(SEQ, "seq", "tr"), "tr", "out")
    q["aoi_ngrams"] = aois.ngrams(SEQ, "seq", "out")
    q["aoi_sequential_patterns"] = aois.sequential_pairs(SEQ, "seq", "out")
    q["aoi_trend"] = aois.trend(SEQ, "seq", "out")
    q["aoi_scarf"] = aois.scarf(SEQ, "seq", "out")
    q["aoi_sankey"] = aois.sankey(SEQ, "seq", "out")
    q["aoi_transition_flow"] = aois.transition_flow(SEQ, "seq", "out")
    # signals, joins, mapping
    lags = signals.log_lags(1, 16, 8)
    curve = signals.msd(GOOD, "good", "msd", lags, FS)
    q["msd"] = curve.then("out", f"SELECT recording_id, lag_, {_r('msd_x', 'msd_y')} FROM msd")
    q["msd_exponents"] = signals.scaling_exponents(curve, "msd", "out", ["msd_x", "msd_y"], (0.5, 5.0), (2.0, 20.0))
    q["dacf"] = signals.dacf(GOOD, "good", "out", list(range(1, 12)), 3)
    asof = Plan().then("lhs", "SELECT user_id AS g, CAST(@micros(ts) AS BIGINT) AS t, event_id AS id FROM {events}").then("rhs", "SELECT user_id AS g, CAST(@micros(ts) AS BIGINT) + 1000000 AS t, event_id AS v FROM {events}")
    q["asof_nearest"] = signals.asof_nearest(asof, "lhs", "rhs", "out", 5e10)
    q["asof_nearest_filled"] = signals.asof_nearest(asof, "lhs", "rhs", "out", 5e10, fill=True)
    # a camera of one frame in 20,000 s, gaze between its frames
    camera = Plan().then("lhs", "SELECT user_id AS g, CAST(@micros(ts) AS BIGINT) AS t, event_id AS id FROM {events}").then("cam", "SELECT g, max(t) + CAST(c - 1 AS BIGINT) * 20000000000 AS t, c - 1 AS frame FROM (SELECT user_id AS g, min(CAST(@micros(ts) AS BIGINT)) AS t, @upto(150) AS c FROM {events} GROUP BY user_id) q GROUP BY g, c")
    q["frame_interpolation"] = signals.interpolated_frames(camera, "lhs", "cam", "out")
    hom = Plan().then("pts", "SELECT event_id AS id, event_id % 50 AS frame, value AS x, CAST(@json_k(props) AS DOUBLE) AS y FROM {events}").then("hom", "SELECT DISTINCT frame, 1.0 + frame / 100.0 AS h11, 0.01 * frame AS h12, 3.0 AS h13, 0.02 AS h21, 0.9 AS h22, CAST(frame AS DOUBLE) AS h23, 0.0001 AS h31, 0.0002 AS h32, 1.0 AS h33 FROM pts WHERE frame % 7 <> 0")
    mapped = signals.map_points(hom, "pts", "hom", "mp")
    q["reference_mapping"] = mapped.then("out", "SELECT id, frame, ref_x, ref_y, mapped FROM mp")
    q["reference_frame_medians"] = mapped.then("out", f"SELECT frame, {r6('median(ref_x)')} AS ref_x, {r6('median(ref_y)')} AS ref_y, count(*) AS n FROM mp GROUP BY frame")
    bars = GOOD.then("bars", "SELECT recording_id, least(x, nx) AS birth, greatest(x, nx) AS death FROM (SELECT recording_id, x, lead(x) OVER (PARTITION BY recording_id ORDER BY i) AS nx FROM good) q WHERE nx IS NOT NULL AND abs(nx - x) > 5")
    q["persistence_curves"] = signals.persistence_curves(bars, "bars", "out", 0.0, 500.0)
    q["persistence_landscapes"] = signals.persistence_landscapes(bars, "bars", "out", 0.0, 500.0)
    q["reference_mapping_filled"] = signals.map_points(hom, "pts", "hom", "mp", 0.0).then("out", "SELECT id, frame, ref_x, ref_y, mapped FROM mp")
    q["smoothing_none"] = kin.smoothed(GOOD, "good", "sm", None).then("out", f"SELECT recording_id, i, {_r('s_x', 's_y')} FROM sm")
    return q


PLANS = _plans()


def run(name: str):
    """The Spark query of a plan: (spark, sf_dir) -> DataFrame."""
    plan = PLANS[name]

    def query(spark, sf_dir):
        return plan.spark(spark, events=spark.read.parquet(f"{sf_dir}/events.parquet")) if "{events}" in plan.text(0) else plan.spark(spark)

    query.__name__ = name
    return query


QUERIES = {name: run(name) for name in PLANS}
ORACLE_SQL = {name: plan.duckdb() for name, plan in PLANS.items()}
