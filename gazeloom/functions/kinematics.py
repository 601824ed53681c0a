"""Per-sample geometry, speeds and smoothing; every step keeps (recording_id, i) and one window."""

from __future__ import annotations

import numpy as np

from .relational import Plan

#: The one window of all per-sample steps, so that Catalyst sorts once.
W = "PARTITION BY recording_id ORDER BY i"


def step3(kind: str = "lead") -> str:
    return f"sqrt(power({kind}(x) OVER w - x, 2) + power({kind}(y) OVER w - y, 2) + power({kind}(z) OVER w - z, 2))"


def _next(c: str) -> str:
    return f"(lead({c}) OVER ({W}))"


def kinematics(p: Plan, source: str, out: str, fs: float, width: float, height: float) -> Plan:
    """Unit gaze vectors, visual angles, angular and Euclidean speed, speed components.

    Forward differences; the last sample repeats the speed before it (0 for one sample) and has zero components.
    """
    p = p.then(
        f"{out}_unit",
        f"""SELECT *, (x - {width / 2}) / nn AS ux, (y - {height / 2}) / nn AS uy, z / nn AS uz,
        degrees(atan((x - {width / 2}) / z)) AS theta_x, degrees(atan((y - {height / 2}) / z)) AS theta_y
        FROM (SELECT *, sqrt(power(x - {width / 2}, 2) + power(y - {height / 2}, 2) + z * z) AS nn FROM {source}) q""",
    )
    dot = f"ux * {_next('ux')} + uy * {_next('uy')} + uz * {_next('uz')}"
    p = p.then(
        f"{out}_step",
        f"""SELECT recording_id, i, x, y, z, status, ux, uy, uz, theta_x, theta_y,
        degrees(acos(greatest(-1.0, least(1.0, {dot})))) * {fs} AS a1,
        sqrt(power({_next("x")} - x, 2) + power({_next("y")} - y, 2) + power({_next("z")} - z, 2)) * {fs} AS e1,
        coalesce({_next("x")} - x, 0) * {fs} AS vx, coalesce({_next("y")} - y, 0) * {fs} AS vy, coalesce({_next("z")} - z, 0) * {fs} AS vz FROM {out}_unit""",
    )
    return p.then(
        out,
        f"""SELECT recording_id, i, x, y, z, status, ux, uy, uz, theta_x, theta_y, vx, vy, vz,
        coalesce(a1, lag(a1) OVER ({W}), 0.0) AS speed_angular, coalesce(e1, lag(e1) OVER ({W}), 0.0) AS speed FROM {out}_step""",
    )


def moving_average(p: Plan, source: str, out: str, window: int, columns: tuple[str, ...] = ("x", "y")) -> Plan:
    """Mean of the last ``window`` samples; the first ``window`` take the value of the sample after them. ``window`` is odd."""
    if window % 2 == 0:
        raise ValueError("the window is odd")
    means = ", ".join(f"avg({c}) OVER ({W} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS m_{c}" for c in columns)
    p = p.then(f"{out}_m", f"SELECT *, {means} FROM {source}")
    pick = ", ".join(f"CASE WHEN i < {window} THEN coalesce(max(CASE WHEN i = {window} THEN m_{c} END) OVER (PARTITION BY recording_id), m_{c}) ELSE m_{c} END AS s_{c}" for c in columns)
    return p.then(out, f"SELECT *, {pick} FROM {out}_m")


def speed_moving_average(p: Plan, source: str, out: str, window: int, fs: float, columns: tuple[str, ...] = ("x", "y")) -> Plan:
    """Smoothed speed, integrated again from the first position.

    With v = (window - 1) / 2 the speed at i is (m(i + v) - m(i - 1)) / ((v + 1) / fs), m being the mean of the last v + 1 positions; the ends are held.
    """
    v = (window - 1) // 2
    means = ", ".join(f"avg({c}) OVER ({W} ROWS BETWEEN {v} PRECEDING AND CURRENT ROW) AS m_{c}" for c in columns)
    p = p.then(f"{out}_m", f"SELECT *, count(*) OVER (PARTITION BY recording_id) AS nn, {means} FROM {source}")
    raw = ", ".join(f"CASE WHEN i > {v} AND i < nn - {v} THEN (lead(m_{c}, {v}) OVER ({W}) - lag(m_{c}, 1) OVER ({W})) / ({(v + 1) / fs}) END AS r_{c}" for c in columns)
    p = p.then(f"{out}_r", f"SELECT *, {raw} FROM {out}_m")
    held = ", ".join(
        f"coalesce(r_{c}, CASE WHEN i <= {v} THEN max(CASE WHEN i = {v + 1} THEN r_{c} END) OVER (PARTITION BY recording_id) ELSE max(CASE WHEN i = nn - {v + 1} THEN r_{c} END) OVER (PARTITION BY recording_id) END, 0) AS v_{c}, first_value({c}) OVER ({W}) AS f_{c}"
        for c in columns
    )
    p = p.then(f"{out}_v", f"SELECT *, {held} FROM {out}_r")
    back = ", ".join(f"f_{c} + coalesce(sum(v_{c}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {fs} AS s_{c}" for c in columns)
    return p.then(out, f"SELECT *, {back} FROM {out}_v")


def savgol_coefficients(window: int, order: int, at: int | None = None) -> list[float]:
    """Weights of the samples of a window in the least-squares polynomial's value at place ``at`` (the middle by default)."""
    half = window // 2
    grid = np.vander(np.arange(window) - half, order + 1, increasing=True).astype(float)
    point = np.power(float((half if at is None else at) - half), np.arange(order + 1))
    return (point @ np.linalg.pinv(grid)).tolist()


def savgol(p: Plan, source: str, out: str, window: int, order: int, columns: tuple[str, ...] = ("x", "y")) -> Plan:
    """Savitzky-Golay smoothing; the first and last half window take the polynomial of the first and last window.

    All weights are constants, so the edges are weighted sums of neighbours, too: one
    sorted pass and no join. Recordings shorter than the window stay as they are.
    """
    half = window // 2
    near = [f"lag({c}, {-k}) OVER ({W}) AS n_{c}_m{-k}" if k < 0 else f"lead({c}, {k}) OVER ({W}) AS n_{c}_p{k}" for c in columns for k in range(1 - window, window) if k]
    p = p.then(f"{out}_n", f"SELECT *, count(*) OVER (PARTITION BY recording_id) AS nn, {', '.join(near)} FROM {source}")

    def at(c: str, k: int) -> str:
        return c if k == 0 else f"n_{c}_m{-k}" if k < 0 else f"n_{c}_p{k}"

    def fir(c: str, place: int | None = None) -> str:
        own = half if place is None else place
        weights = savgol_coefficients(window, order) if place is None else savgol_coefficients(window, order, place)
        return " + ".join(f"{w!r} * {at(c, k - own)}" for k, w in enumerate(weights))

    def smooth(c: str) -> str:
        first = " ".join(f"WHEN i = {k} THEN {fir(c, k)}" for k in range(half))
        last = " ".join(f"WHEN i = nn - {window - k} THEN {fir(c, k)}" for k in range(half + 1, window))
        return f"CASE WHEN nn < {window} THEN {c} {first} {last} ELSE {fir(c)} END AS s_{c}"

    helpers = ", ".join(x.rsplit(" ", 1)[1] for x in near)
    return p.then(out, f"SELECT @except(nn, {helpers}), {', '.join(map(smooth, columns))} FROM {out}_n")


def clean_signal(p: Plan, source: str, out: str, column: str = "x", max_gap: int | None = None) -> Plan:
    """Linear interpolation over samples with status 0 or null value; ends hold the nearest value; inner gaps longer than ``max_gap`` stay null."""
    p = p.then(f"{out}_v", f"SELECT recording_id, i, CASE WHEN status > 0 THEN {column} END AS v FROM {source}")
    p = p.then(
        f"{out}_b",
        f"""SELECT recording_id, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i0,
        min(CASE WHEN v IS NOT NULL THEN i END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM {out}_v""",
    )
    limit = f"CASE WHEN b.i1 - b.i0 - 1 > {max_gap} THEN NULL ELSE" if max_gap is not None else "CASE WHEN 1 = 0 THEN NULL ELSE"
    ends = "coalesce(l.v, r.v)" if max_gap is None else "CASE WHEN l.v IS NULL OR r.v IS NULL THEN NULL ELSE l.v END"
    return p.then(
        out,
        f"""SELECT b.recording_id, b.i, coalesce(b.v, CASE WHEN b.i0 IS NULL OR b.i1 IS NULL THEN {ends} ELSE {limit} l.v + (r.v - l.v) * (b.i - b.i0) / (b.i1 - b.i0) END END) AS {column}
        FROM {out}_b b LEFT JOIN {out}_v l ON b.recording_id = l.recording_id AND b.i0 = l.i LEFT JOIN {out}_v r ON b.recording_id = r.recording_id AND b.i1 = r.i""",
    )


def normalised(p: Plan, source: str, out: str, column: str) -> Plan:
    """z-scores with the population deviation; where it is zero the first value stands for it."""
    return p.then(out, f"SELECT recording_id, i, ({column} - avg({column}) OVER (PARTITION BY recording_id)) / nullif(CASE WHEN stddev_pop({column}) OVER (PARTITION BY recording_id) = 0 THEN first_value({column}) OVER ({W}) ELSE stddev_pop({column}) OVER (PARTITION BY recording_id) END, 0) AS z FROM {source}")


def spatial_bins(p: Plan, source: str, out: str, nx: int, ny: int, width: float, height: float) -> Plan:
    """Grid cell of each point; the far edges belong to the last cells."""
    return p.then(out, f"SELECT *, CAST(floor(least(x, {width - 0.001}) / {width / nx}) AS BIGINT) AS gx, CAST(floor(least(y, {height - 0.001}) / {height / ny}) AS BIGINT) AS gy FROM {source}")


def joint_bins(p: Plan, source: str, pairs: str, out: str, nx: int, ny: int) -> Plan:
    """(id_1, id_2, side, k, gx, gy): grid cells of both scanpaths (recording_id, k, x, y) of each pair, on the plane from 0 to the pair's largest coordinates."""
    p = p.then(f"{out}_m", f"SELECT recording_id, max(x) AS mx, max(y) AS my FROM {source} GROUP BY recording_id")
    p = p.then(f"{out}_p", f"SELECT q.id_1, q.id_2, greatest(a.mx, b.mx) + 0.001 AS wx, greatest(a.my, b.my) + 0.001 AS wy FROM {pairs} q JOIN {out}_m a ON a.recording_id = q.id_1 JOIN {out}_m b ON b.recording_id = q.id_2")
    cell = lambda c, n: f"CAST(floor(least(s.{c}, q.w{c} - 0.001) / (q.w{c} / {n})) AS BIGINT) AS g{c}"
    return p.then(out, " UNION ALL ".join(f"SELECT q.id_1, q.id_2, {side} AS side, s.k, {cell('x', nx)}, {cell('y', ny)} FROM {out}_p q JOIN {source} s ON s.recording_id = q.id_{side}" for side in (1, 2)))


#: Smoothing by name; the first leaves positions as they are.
SMOOTHINGS = ("none", "moving_average", "speed_moving_average", "savgol")


def smoothed(p: Plan, source: str, out: str, method: str | None, window: int = 5, order: int = 3, fs: float = 1.0) -> Plan:
    """``source`` with ``s_x`` and ``s_y`` by the named method."""
    if method in (None, "none"):
        return p.then(out, f"SELECT *, x AS s_x, y AS s_y FROM {source}")
    if method == "moving_average":
        return moving_average(p, source, out, window)
    if method == "speed_moving_average":
        return speed_moving_average(p, source, out, window, fs)
    if method == "savgol":
        return savgol(p, source, out, window, order)
    raise ValueError(f"no smoothing named {method}; there are {', '.join(SMOOTHINGS)}")


def bin_corners(p: Plan, out: str, nx: int, ny: int, width: float, height: float) -> Plan:
    """(symbol, x, y): the lower corner of each grid cell by its name."""
    p = p.then(f"{out}_x", f"SELECT @upto({nx}) AS c").then(f"{out}_y", f"SELECT @upto({ny}) AS c")
    return p.then(out, f"SELECT concat(@letter(v.c - 1), @letter(u.c - 1)) AS symbol, (u.c - 1) * {width / nx} AS x, (v.c - 1) * {height / ny} AS y FROM {out}_x u CROSS JOIN {out}_y v")


def bin_distances(p: Plan, out: str, nx: int, ny: int, width: float, height: float) -> Plan:
    """(gx1, gy1, gx2, gy2, distance): distance of each two grid cells, as a share of the largest; of the grid's size, whatever the input."""
    p = p.then(f"{out}_x", f"SELECT @upto({nx}) AS c").then(f"{out}_y", f"SELECT @upto({ny}) AS c")
    p = p.then(f"{out}_c", f"SELECT CAST(u.c - 1 AS BIGINT) AS gx, CAST(v.c - 1 AS BIGINT) AS gy FROM {out}_x u CROSS JOIN {out}_y v")
    apart = f"sqrt(power((a.gx - b.gx) * {width / nx}, 2) + power((a.gy - b.gy) * {height / ny}, 2))"
    return p.then(out, f"SELECT gx1, gy1, gx2, gy2, d / nullif(max(d) OVER (), 0) AS distance FROM (SELECT a.gx AS gx1, a.gy AS gy1, b.gx AS gx2, b.gy AS gy2, {apart} AS d FROM {out}_c a CROSS JOIN {out}_c b) q")
