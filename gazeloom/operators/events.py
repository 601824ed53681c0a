"""Metrics of fixations, saccades and pursuits: one wide table per event, one per recording.

Speeds of an event leave out its last sample; durations count all samples. Deviations
are sample deviations, 0 for fewer than two values. Distances are Euclidean in three
dimensions or, on request, visual angles in degrees between gaze vectors (x, y, z).
"""

from __future__ import annotations

from ..functions.kinematics import W
from ..functions.relational import Plan, bcea_sql, r6
from .islands import run_samples


def distance(kind: str, a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    """Distance of two gaze vectors: ``euclidean`` or ``angular`` (degrees)."""
    if kind == "euclidean":
        return "sqrt(" + " + ".join(f"power({v} - {u}, 2)" for u, v in zip(a, b, strict=True)) + ")"
    if kind != "angular":
        raise ValueError(f"no distance named {kind}")
    dot = lambda u, v: " + ".join(f"{s} * {t}" for s, t in zip(u, v, strict=True))
    return f"degrees(acos(greatest(-1.0, least(1.0, ({dot(a, b)}) / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0)))))"


def event_table(p: Plan, samples: str, where: str, out: str, fs: float, labelled: str = "1 = 1", bcea_probability: float = 0.68, initial: float = 0.02, kind: str = "euclidean") -> Plan:
    """(recording_id, k, a, b) with durations, centroids, speeds, accelerations, displacement, path, BCEA, direction, curvature; ``n_samples`` and ``n_labelled`` count the recording's samples.

    ``samples`` carry the first and last sample ``a``, ``b`` of their run; those with ``where`` are events. ``kind`` is the
    distance of ``displacement`` and ``path``; directions and curvature stay in the plane. ``pool_mean`` and ``pool_sd`` are of the speeds of all events of the recording.
    """
    t_s = int(initial * fs) + 1
    ev = "PARTITION BY recording_id, a"
    whole = "OVER (PARTITION BY recording_id)"
    # the Euclidean step to the next sample is its speed already
    ahead = "".join(f", lead({c}) OVER ({ev} ORDER BY i) AS n{c}" for c in "xyz") if kind != "euclidean" else ""
    to_next = distance(kind, ("x", "y", "z"), ("nx", "ny", "nz")) if ahead else f"speed / {fs}"
    p = p.then(f"{out}_n", f"SELECT *, count(*) {whole} AS n_samples, sum(CASE WHEN {labelled} THEN 1 ELSE 0 END) {whole} AS n_labelled FROM {samples}")
    p = p.then(f"{out}_s", f"SELECT recording_id, i, x, y, z, speed, a, b, n_samples, n_labelled{ahead} FROM {out}_n WHERE {where}")
    p = p.then(
        f"{out}_e",
        f"""SELECT *, first_value(x) OVER ({ev} ORDER BY i) AS xa, first_value(y) OVER ({ev} ORDER BY i) AS ya, max(CASE WHEN i = b THEN x END) OVER ({ev}) AS xb, max(CASE WHEN i = b THEN y END) OVER ({ev}) AS yb, first_value(z) OVER ({ev} ORDER BY i) AS za, max(CASE WHEN i = b THEN z END) OVER ({ev}) AS zb,
        CASE WHEN i < b THEN {to_next} END AS step, avg(CASE WHEN i < b THEN speed END) {whole} AS pool_mean, stddev_samp(CASE WHEN i < b THEN speed END) {whole} AS pool_sd,
        max(CASE WHEN i = a + least({t_s}, b - a) THEN x END) OVER ({ev}) AS xt, max(CASE WHEN i = a + least({t_s}, b - a) THEN y END) OVER ({ev}) AS yt,
        max(CASE WHEN i < b THEN speed END) OVER ({ev}) AS pk, CASE WHEN i + 1 < b THEN abs(lead(speed) OVER ({ev} ORDER BY i) - speed) * {fs} END AS acc FROM {out}_s""",
    )
    p = p.then(f"{out}_p", f"SELECT *, min(CASE WHEN i < b AND speed = pk THEN i END) OVER ({ev}) AS pi_, sqrt(power(xb - xa, 2) + power(yb - ya, 2)) AS chord, {distance(kind, ("xa", "ya", "za"), ("xb", "yb", "zb"))} AS far FROM {out}_e")
    p = p.then(
        f"{out}_c",
        f"""SELECT *, coalesce(abs((xb - xa) * (y - ya) - (yb - ya) * (x - xa)) / nullif(chord, 0), 0) AS perp, coalesce(((x - xa) * (xb - xa) + (y - ya) * (yb - ya)) / nullif(chord, 0), 0) AS along FROM {out}_p""",
    )
    p = p.then(f"{out}_d", f"SELECT *, coalesce(perp * (along - lag(along) OVER ({ev} ORDER BY i)), 0) AS slice FROM {out}_c")
    angle = lambda dx, dy: f"(degrees(atan2({dy} + 1e-10, {dx} + 1e-10)) + CASE WHEN atan2({dy} + 1e-10, {dx} + 1e-10) < 0 THEN 360 ELSE 0 END)"
    agg = lambda f, c, where: f"{f}(CASE WHEN {where} THEN {c} END)"
    p = p.then(
        f"{out}_a",
        f"""SELECT recording_id, a, b, b - a + 1 AS n, max(n_samples) AS n_samples, max(n_labelled) AS n_labelled, (b - a + 1) / CAST({fs} AS DOUBLE) AS duration, avg(x) AS cx, avg(y) AS cy,
        {agg("avg", "speed", "i < b")} AS mean_speed, coalesce({agg("stddev_samp", "speed", "i < b")}, 0.0) AS sd_speed, max(pk) AS peak, max(pi_) AS peak_i,
        max(far) AS displacement, max(chord) AS chord, sum(step) AS path, max(pool_mean) AS pool_mean, coalesce(max(pool_sd), 0.0) AS pool_sd,
        CASE WHEN count(*) > 1 THEN {bcea_sql(bcea_probability)} END AS bcea,
        {angle("max(xb - xa)", "max(yb - ya)")} AS direction, {angle("max(xt - xa)", "max(yt - ya)")} AS initial_direction,
        max(xb - xa) AS dx, max(yb - ya) AS dy, max(xt - xa) AS tx, max(yt - ya) AS ty,
        max(perp) AS max_curvature, sum(slice) AS area_curvature,
        avg(acc) AS mean_acc, coalesce(stddev_samp(acc), 0.0) AS sd_acc, {agg("avg", "acc", "i < pi_")} AS mean_up, {agg("avg", "acc", "i >= pi_")} AS mean_down, {agg("max", "acc", "i < pi_")} AS peak_up, {agg("max", "acc", "i >= pi_")} AS peak_down
        FROM {out}_d GROUP BY recording_id, a, b""",
    )
    return p.then(out, f"SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a) - 1 AS BIGINT) AS k FROM {out}_a")


def mean_sd(column: str, name: str) -> str:
    return f"{r6(f'avg({column})')} AS {name}_mean, {r6(f'coalesce(stddev_samp({column}), 0.0)')} AS {name}_sd"


def _weighted(c: str, w: str) -> str:
    return f"sum({w} * {c}) / nullif(sum({w}), 0)"


def _weighted_known(c: str, w: str) -> str:
    """Weighted mean of the known values only."""
    return f"sum({w} * {c}) / nullif(sum(CASE WHEN {c} IS NOT NULL THEN {w} END), 0)"


def per_recording(p: Plan, events: str, out: str, fs: float, metrics: list[str]) -> Plan:
    """One row per recording with an event: counts and rates, then the given metric columns over its events."""
    rate = [f"count(*) AS n_events", r6(f"count(*) / (max(n_samples) / CAST({fs} AS DOUBLE))") + " AS frequency", r6(f"count(*) / nullif(max(n_labelled) / CAST({fs} AS DOUBLE), 0)") + " AS frequency_labelled"]
    return p.then(out, f"SELECT recording_id, {', '.join(rate + metrics)} FROM {events} GROUP BY recording_id")


FIXATION = [
    mean_sd("duration", "duration"),
    mean_sd("mean_speed", "velocity"),
    r6(_weighted("mean_speed", "(n - 1)")) + " AS velocity_weighted",
    r6(f"sqrt({_weighted('sd_speed * sd_speed', '(n - 1)')})") + " AS velocity_pooled_sd",
    mean_sd("displacement", "drift_displacement"),
    mean_sd("path", "drift_distance"),
    mean_sd("displacement / nullif((n - 1) / CAST({fs} AS DOUBLE), 0)", "drift_velocity"),
    mean_sd("bcea", "bcea"),
    # weights and durations that count all samples
    r6(_weighted("mean_speed", "n")) + " AS velocity_weighted_samples",
    r6(f"sqrt({_weighted('sd_speed * sd_speed', 'n')})") + " AS velocity_pooled_sd_samples",
    mean_sd("displacement / (n / CAST({fs} AS DOUBLE))", "drift_velocity_samples"),
]

SACCADE = [
    mean_sd("duration", "duration"),
    mean_sd("displacement", "amplitude"),
    mean_sd("path", "travel"),
    mean_sd("amplitude3 / nullif(path, 0)", "efficiency"),
    mean_sd("direction", "direction"),
    mean_sd("degrees(acos(greatest(-1.0, least(1.0, abs(dx) / nullif(chord, 0)))))", "horizontal_deviation"),
    mean_sd("degrees(acos(greatest(-1.0, least(1.0, dx / nullif(chord, 0)))))", "horizontal_angle"),
    mean_sd("successive", "successive_deviation"),
    mean_sd("initial_direction", "initial_direction"),
    mean_sd("degrees(acos(greatest(-1.0, least(1.0, (dx * tx + dy * ty) / nullif(chord * sqrt(tx * tx + ty * ty), 0)))))", "initial_deviation"),
    mean_sd("max_curvature", "max_curvature"),
    mean_sd("area_curvature", "area_curvature"),
    mean_sd("mean_speed", "velocity"),
    r6(_weighted("mean_speed", "(n - 1)")) + " AS velocity_weighted",
    r6(f"sqrt({_weighted('sd_speed * sd_speed', '(n - 1)')})") + " AS velocity_pooled_sd",
    mean_sd("peak", "peak_velocity"),
    mean_sd("mean_acc", "acceleration_profile"),
    r6(_weighted("mean_speed", "n")) + " AS velocity_weighted_samples",
    r6(f"sqrt({_weighted('sd_speed * sd_speed', 'n')})") + " AS velocity_pooled_sd_samples",
    r6(_weighted_known("mean_acc", "greatest(n - 2, 0)")) + " AS acceleration_profile_weighted",
    r6(_weighted_known("mean_up", "greatest(n - 2, 0)")) + " AS acceleration_weighted",
    r6(_weighted_known("mean_down", "greatest(n - 2, 0)")) + " AS deceleration_weighted",
    mean_sd("mean_up", "acceleration"),
    mean_sd("mean_down", "deceleration"),
    mean_sd("peak_up", "peak_acceleration"),
    mean_sd("peak_down", "peak_deceleration"),
    mean_sd("(peak_i - a) / nullif(CAST(n - 1 AS DOUBLE), 0)", "skewness_exponent"),
    mean_sd("amplitude3 / duration", "amplitude_duration_ratio"),
    mean_sd("peak / nullif(amplitude3, 0)", "peak_velocity_amplitude_ratio"),
    mean_sd("peak / duration", "peak_velocity_duration_ratio"),
    mean_sd("peak / nullif(amplitude3 / duration, 0)", "peak_velocity_velocity_ratio"),
    mean_sd("peak_up / nullif(peak_down, 0)", "acceleration_deceleration_ratio"),
    # slopes from centred sums, which both engines round alike
    r6("covar_samp(amplitude3, duration) / nullif(var_samp(duration), 0)") + " AS main_sequence_amplitude_duration",
    r6("covar_samp(ln(nullif(peak, 0)), ln(nullif(amplitude3, 0))) / nullif(var_samp(CASE WHEN peak > 0 THEN ln(nullif(amplitude3, 0)) END), 0)") + " AS main_sequence_log",
]

PURSUIT = [
    mean_sd("duration", "duration"),
    r6("sum(n) / CAST(max(n_samples) AS DOUBLE)") + " AS proportion",
    mean_sd("mean_speed", "velocity"),
    mean_sd("peak", "peak_velocity"),
    mean_sd("displacement", "amplitude"),
    mean_sd("path", "distance"),
    mean_sd("displacement / nullif(path, 0)", "efficiency"),
    r6("max(pool_mean)") + " AS velocity_pooled",
    r6("max(pool_sd)") + " AS velocity_pooled_sd",
]


def saccade_columns(p: Plan, events: str, out: str) -> Plan:
    """Adds the rounded amplitude that the ratios use and the angle to the chord of the previous saccade."""
    prev = "PARTITION BY recording_id ORDER BY k"
    p = p.then(f"{out}_l", f"SELECT *, floor(displacement * 1000 + 0.5) / 1000 AS amplitude3, lag(dx) OVER ({prev}) AS pdx, lag(dy) OVER ({prev}) AS pdy FROM {events}")
    return p.then(out, f"SELECT *, degrees(acos(greatest(-1.0, least(1.0, (dx * pdx + dy * pdy) / nullif(sqrt(dx * dx + dy * dy) * sqrt(pdx * pdx + pdy * pdy), 0))))) AS successive FROM {out}_l")


def pursuit_task(p: Plan, samples: str, target: str, where: str, out: str, fs: float, start: int, tolerance: float = 1.0, accuracy: float = 0.15, kind: str = "euclidean") -> Plan:
    """Pursuit of a known target: per recording counts, slope ratios and gain, crossing times, speed gains and accuracy.

    The target's sample j meets the gaze sample ``start + j``; pursuits are the runs of samples with ``where`` inside that window.
    """
    p = p.then(f"{out}_w", f"SELECT s.recording_id, s.i, s.status, s.x, s.y, s.z, s.speed, s.label, t.x AS tx, t.y AS ty FROM {samples} s JOIN {target} t ON s.recording_id = t.recording_id AND s.i = t.i + {start}")
    p = p.then(f"{out}_r", f"SELECT recording_id, min(i) AS lo, max(i) AS hi, count(*) AS n_window FROM {out}_w GROUP BY recording_id")
    p = run_samples(p, f"{out}_w", f"{out}_s", where)
    run = "PARTITION BY recording_id, a ORDER BY i"
    far = distance(kind, tuple(f"first_value({c}) OVER ({run})" for c in "xyz"), ("x", "y", "z"))
    to_next = distance(kind, ("x", "y", "z"), tuple(f"lead({c}) OVER ({run})" for c in "xyz"))
    p = p.then(f"{out}_t", f"SELECT *, {far} AS far, {to_next} AS step, avg(CASE WHEN i < b THEN speed END) OVER (PARTITION BY recording_id) AS pool_mean, stddev_samp(CASE WHEN i < b THEN speed END) OVER (PARTITION BY recording_id) AS pool_sd FROM {out}_s")
    slope = lambda c: f"covar_samp({c}, i) / nullif(var_samp(i), 0)"
    p = p.then(f"{out}_v", f"SELECT recording_id, a, b, b - a + 1 AS n, ({slope('x')}) / nullif({slope('tx')}, 0) AS ratio_x, ({slope('y')}) / nullif({slope('ty')}, 0) AS ratio_y, avg(CASE WHEN i < b THEN speed END) AS v, max(CASE WHEN i < b THEN speed END) AS peak, sum(step) AS path, max(CASE WHEN i = b THEN far END) AS amplitude, max(pool_mean) AS pool_mean, coalesce(max(pool_sd), 0.0) AS pool_sd FROM {out}_t GROUP BY recording_id, a, b")
    near = lambda c: f"CASE WHEN ratio_{c} > {1 - accuracy} AND ratio_{c} < {1 + accuracy} THEN 1e0 ELSE 0e0 END"
    known = lambda c: f"nullif(sum(CASE WHEN ratio_{c} IS NOT NULL THEN n END), 0)"
    gains = ", ".join(f"avg(ratio_{c}) AS gain_{c}, sum(n * ratio_{c}) / {known(c)} AS weighted_gain_{c}, avg({near(c)}) AS accuracy_{c}, sum(n * {near(c)}) / {known(c)} AS weighted_accuracy_{c}" for c in "xy")
    p = p.then(f"{out}_iv", f"""SELECT recording_id, count(*) AS n_events, avg(n) / {fs} AS duration, sum(n) AS n_in, avg(v) AS velocity, max(pool_mean) AS velocity_pooled, max(pool_sd) AS velocity_pooled_sd, avg(peak) AS peak, avg(path) AS distance,
        avg(amplitude) AS amplitude, avg(amplitude / nullif(path, 0)) AS efficiency, {gains} FROM {out}_v GROUP BY recording_id""")
    d = lambda c: f"(lead({c}) OVER ({W}) - {c})"
    p = p.then(f"{out}_g", f"SELECT recording_id, i, x, y, tx, ty, {d('x')} AS gx, {d('y')} AS gy, {d('tx')} AS hx, {d('ty')} AS hy FROM {out}_w")
    p = p.then(f"{out}_o", f"""SELECT recording_id, avg(sqrt(gx * gx + gy * gy) / nullif(sqrt(hx * hx + hy * hy), 0)) AS overall, avg(gx / nullif(hx, 0)) AS overall_x, avg(gy / nullif(hy, 0)) AS overall_y,
        min(CASE WHEN abs(x - tx) < {tolerance} THEN i END) - min(i) AS cross_x, min(CASE WHEN abs(y - ty) < {tolerance} THEN i END) - min(i) AS cross_y FROM {out}_g GROUP BY recording_id""")
    cols = ", ".join(f"{r6(f'v.{c}')} AS {c}" for c in ("duration", "velocity", "velocity_pooled", "velocity_pooled_sd", "peak", "distance", "amplitude", "efficiency", *(f"{m}_{d}" for m in ("gain", "weighted_gain", "accuracy", "weighted_accuracy") for d in "xy")))
    return p.then(
        out,
        f"""SELECT r.recording_id, coalesce(v.n_events, 0) AS n_events, {r6(f"coalesce(v.n_events, 0) / (r.n_window / CAST({fs} AS DOUBLE))")} AS frequency, {r6("coalesce(v.n_in, 0) / CAST(r.n_window AS DOUBLE)")} AS proportion, {cols},
        {r6("o.overall")} AS overall_gain, {r6("o.overall_x")} AS overall_gain_x, {r6("o.overall_y")} AS overall_gain_y, {r6(f"o.cross_x / CAST({fs} AS DOUBLE)")} AS crossing_x, {r6(f"o.cross_y / CAST({fs} AS DOUBLE)")} AS crossing_y
        FROM {out}_r r LEFT JOIN {out}_iv v ON r.recording_id = v.recording_id JOIN {out}_o o ON r.recording_id = o.recording_id""",
    )


def approximate_entropy(p: Plan, samples: str, out: str, window: int = 10, tolerance: float = 0.1, column: str = "e") -> Plan:
    """Approximate entropy of a series: mean log share of windows within the tolerance (largest difference), length m less length m + 1."""
    shares = []
    for m in (window, window + 1):
        cols = ", ".join(f"lead({column}, {k}) OVER ({W}) AS c{k}" for k in range(m))
        p = p.then(f"{out}_m{m}", f"SELECT * FROM (SELECT recording_id, i, {cols} FROM {samples}) q WHERE c{m - 1} IS NOT NULL")
        near = " AND ".join(f"abs(u.c{k} - v.c{k}) < {tolerance}" for k in range(m))
        p = p.then(f"{out}_n{m}", f"SELECT u.recording_id, u.i, count(*) AS n FROM {out}_m{m} u JOIN {out}_m{m} v ON u.recording_id = v.recording_id WHERE {near} GROUP BY u.recording_id, u.i")
        p = p.then(f"{out}_t{m}", f"SELECT recording_id, count(*) AS total FROM {out}_m{m} GROUP BY recording_id")
        p = p.then(f"{out}_p{m}", f"SELECT n.recording_id, avg(ln(n.n / CAST(t.total AS DOUBLE))) AS phi FROM {out}_n{m} n JOIN {out}_t{m} t ON n.recording_id = t.recording_id GROUP BY n.recording_id")
        shares.append(f"{out}_p{m}")
    return p.then(out, f"SELECT u.recording_id, {r6('u.phi - v.phi')} AS approximate_entropy FROM {shares[0]} u JOIN {shares[1]} v ON u.recording_id = v.recording_id")
