"""Stochastic signal descriptors by lag tables, as-of joins, reference-image mapping and persistence curves."""

from __future__ import annotations

import numpy as np

from ..functions.kinematics import W
from ..functions.relational import Plan, r6


def log_lags(low: int, high: int, count: int) -> list[int]:
    """Distinct lags on a logarithmic scale."""
    return sorted({int(x) for x in np.floor(np.logspace(np.log10(low), np.log10(high), count) + 1e-9)})


def msd(p: Plan, source: str, out: str, lags: list[int], fs: float) -> Plan:
    """Mean squared displacement per recording, axis and lag (lags up to a quarter of the samples), with log time and log value."""
    leads = ", ".join(f"power(lead({c}, {k}) OVER ({W}) - {c}, 2) AS d{c}{k}" for k in lags for c in "xy")
    p = p.then(f"{out}_d", f"SELECT recording_id, count(*) OVER (PARTITION BY recording_id) AS n, {leads} FROM {source}")
    means = ", ".join(f"avg(d{c}{k}) AS m{c}{k}" for k in lags for c in "xy")
    p = p.then(f"{out}_m", f"SELECT recording_id, max(n) AS n, {means} FROM {out}_d GROUP BY recording_id")
    # one row per recording is left, so the lags are rows again at little cost
    each = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag_" for k in lags)
    pick = lambda c: "CASE lag_ " + " ".join(f"WHEN {k} THEN m{c}{k}" for k in lags) + " END"
    return p.then(f"{out}_k", each).then(out, f"SELECT recording_id, lag_, lag_ / CAST({fs} AS DOUBLE) AS seconds, {pick('x')} AS msd_x, {pick('y')} AS msd_y FROM {out}_m CROSS JOIN {out}_k WHERE lag_ * 4 <= n")


def scaling_exponents(p: Plan, curve: str, out: str, columns: list[str], short: tuple[float, float], long: tuple[float, float]) -> Plan:
    """Log-log slopes of curves over time within two ranges of seconds."""
    def slope(c: str, lo: float, hi: float) -> str:
        inside = f"seconds >= {lo} AND seconds <= {hi} AND {c} > 0"
        return f"covar_samp(CASE WHEN {inside} THEN ln({c}) END, CASE WHEN {inside} THEN ln(seconds) END) / nullif(var_samp(CASE WHEN {inside} THEN ln(seconds) END), 0)"

    cols = ", ".join(f"{r6(slope(c, *span))} AS {c}_{name}" for c in columns for name, span in (("short", short), ("long", long)))
    return p.then(out, f"SELECT recording_id, {cols} FROM {curve} GROUP BY recording_id")


def dacf(p: Plan, source: str, out: str, lags: list[int], order: int = 20) -> Plan:
    """Autocorrelation of displacements over ``order`` samples at given lags, relative to the first lag."""
    p = p.then(f"{out}_d", f"SELECT recording_id, i, lead(x, {order}) OVER ({W}) - x AS d FROM {source}")
    leads = ", ".join(f"d * lead(d, {k}) OVER ({W}) AS c{k}" for k in lags)
    p = p.then(f"{out}_l", f"SELECT recording_id, {leads} FROM {out}_d")
    p = p.then(f"{out}_m", "SELECT recording_id, " + ", ".join(f"avg(c{k}) AS m{k}" for k in lags) + f" FROM {out}_l GROUP BY recording_id")
    p = p.then(f"{out}_k", " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lag_" for k in lags))
    pick = "CASE lag_ " + " ".join(f"WHEN {k} THEN m{k}" for k in lags) + " END"
    return p.then(out, f"SELECT recording_id, lag_, {r6(f'({pick}) / nullif(m{min(lags)}, 0)')} AS dacf FROM {out}_m CROSS JOIN {out}_k WHERE {pick} IS NOT NULL AND m{min(lags)} IS NOT NULL")


def asof_nearest(p: Plan, left: str, right: str, out: str, tolerance: float | None = None, fill: bool = False) -> Plan:
    """Nearest right row (g, t, v) of each left row (g, t, id) within the group ``g``; ties look backward; beyond the tolerance null, or with ``fill`` the nearest row all the same, and ``within`` tells which.

    Both sides are put in one order once; the neighbours are the last and the next right row there. Of right rows at one time the largest value counts.
    """
    p = p.then(f"{out}_u", f"SELECT g, t, id, CAST(NULL AS DOUBLE) AS rt, CAST(NULL AS BIGINT) AS v, 1 AS side FROM {left} UNION ALL SELECT g, t, NULL AS id, CAST(t AS DOUBLE) AS rt, max(v) AS v, 0 AS side FROM {right} GROUP BY g, t")
    back, ahead = "PARTITION BY g ORDER BY t, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY g ORDER BY t DESC, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    p = p.then(f"{out}_w", f"SELECT g, t, id, side, max(rt) OVER ({back}) AS t0, min(rt) OVER ({ahead}) AS t1 FROM {out}_u")
    limit = f"AND abs(w.near - w.t) <= {tolerance}" if tolerance is not None and not fill else ""
    within = f", CASE WHEN abs(w.near - w.t) <= {tolerance} THEN 1 ELSE 0 END AS within" if tolerance is not None and fill else ""
    p = p.then(f"{out}_n", f"SELECT g, t, id, CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND t - t0 <= t1 - t) THEN t0 ELSE t1 END AS near FROM {out}_w WHERE side = 1")
    return p.then(out, f"SELECT w.g, w.id, w.t, r.v{within} FROM {out}_n w LEFT JOIN (SELECT g, t, max(v) AS v FROM {right} GROUP BY g, t) r ON w.g = r.g AND w.near = r.t {limit}")


def interpolated_frames(p: Plan, points: str, frames: str, out: str) -> Plan:
    """Frame number of each point (g, t, id) between the frames (g, t, frame) around it, linear in time, halves to even; before the first and after the last frame theirs.

    Frame numbers grow with time. A point in a group without frames has none.
    """
    p = p.then(f"{out}_u", f"SELECT g, t, id, CAST(NULL AS BIGINT) AS ft, CAST(NULL AS BIGINT) AS frame, 1 AS side FROM {points} UNION ALL SELECT g, t, NULL AS id, t AS ft, max(frame) AS frame, 0 AS side FROM {frames} GROUP BY g, t")
    back, ahead = (f"OVER (PARTITION BY g ORDER BY t{way}, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for way in ("", " DESC"))
    p = p.then(f"{out}_w", f"SELECT g, t, id, side, max(ft) {back} AS t0, max(frame) {back} AS f0, min(ft) {ahead} AS t1, min(frame) {ahead} AS f1 FROM {out}_u")
    return p.then(out, f"SELECT g, id, t, CAST(@half_even(CASE WHEN t0 IS NULL THEN f1 WHEN t1 IS NULL OR t1 = t0 THEN f0 ELSE f0 + (f1 - f0) * ((t - t0) / CAST(t1 - t0 AS DOUBLE)) END) AS BIGINT) AS frame FROM {out}_w WHERE side = 1")


def map_points(p: Plan, points: str, homographies: str, out: str, fill: float | None = None) -> Plan:
    """Perspective mapping of points (frame, x, y) by a homography per frame (h11 ... h33), to three decimals; points of frames without one stay unmapped, with ``fill`` for their place."""
    den = "nullif(h.h31 * p.x + h.h32 * p.y + h.h33, 0)"
    place = lambda a: f"floor((h.h{a}1 * p.x + h.h{a}2 * p.y + h.h{a}3) / {den} * 1000 + 0.5) / 1000"
    mapped = lambda a: place(a) if fill is None else f"coalesce({place(a)}, {fill})"
    return p.then(out, f"SELECT p.id, p.frame, p.x, p.y, {mapped(1)} AS ref_x, {mapped(2)} AS ref_y, CASE WHEN h.frame IS NULL THEN 0 ELSE 1 END AS mapped FROM {points} p LEFT JOIN {homographies} h ON p.frame = h.frame")


def persistence_curves(p: Plan, bars: str, out: str, low: float, high: float, cells: int = 50) -> Plan:
    """Betti curve, persistence curve, largest landscape value and persistence entropy of bars (recording_id, birth, death) on a grid."""
    p = p.then(f"{out}_g", f"SELECT {low} + (c - 1) * {(high - low) / (cells - 1)} AS t, CAST(c AS BIGINT) AS cell FROM (SELECT @upto({cells}) AS c) q")
    p = p.then(f"{out}_a", f"SELECT b.recording_id, g.cell, b.death - b.birth AS life, least(g.t - b.birth, b.death - g.t) AS tent FROM {bars} b JOIN {out}_g g ON g.t >= b.birth AND g.t < b.death")
    p = p.then(f"{out}_s", f"SELECT *, life / sum(life) OVER (PARTITION BY recording_id, cell) AS q FROM {out}_a WHERE life > 0")
    return p.then(out, f"SELECT recording_id, cell, count(*) AS betti, {r6('sum(life)')} AS persistence, {r6('max(tent)')} AS landscape, {r6('-sum(q * log10(q))')} AS entropy FROM {out}_s GROUP BY recording_id, cell")


def persistence_landscapes(p: Plan, bars: str, out: str, low: float, high: float, order: int = 3, cells: int = 50) -> Plan:
    """(recording_id, cell, level, value): the ``order`` largest tent values of bars (recording_id, birth, death) at each point of a grid; zero values have no row."""
    p = p.then(f"{out}_g", f"SELECT {low} + (c - 1) * {(high - low) / (cells - 1)} AS t, CAST(c AS BIGINT) AS cell FROM (SELECT @upto({cells}) AS c) q")
    p = p.then(f"{out}_a", f"SELECT b.recording_id, g.cell, least(g.t - b.birth, b.death - g.t) AS tent FROM {bars} b JOIN {out}_g g ON g.t > b.birth AND g.t < b.death")
    p = p.then(f"{out}_r", f"SELECT *, CAST(row_number() OVER (PARTITION BY recording_id, cell ORDER BY tent DESC) AS BIGINT) AS level FROM {out}_a")
    return p.then(out, f"SELECT recording_id, cell, level, {r6('tent')} AS value FROM {out}_r WHERE level <= {order}")
