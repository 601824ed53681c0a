"""Scanpaths (recording_id, k, x, y, dur): geometry, recurrence, saliency, similarity by joins."""

from __future__ import annotations

import numpy as np

from ..functions.relational import Plan, bcea_sql, r6

WK = "PARTITION BY recording_id ORDER BY k"


def from_fixations(p: Plan, events: str, out: str) -> Plan:
    """Fixations in order, with centroid and duration."""
    return p.then(out, f"SELECT recording_id, CAST(row_number() OVER ({WK}) - 1 AS BIGINT) AS k, cx AS x, cy AS y, duration AS dur FROM {events}")


def from_mapped_gaze(p: Plan, events: str, gaze: str, out: str, width: float, height: float) -> Plan:
    """Fixations (recording_id, a, b, duration) on a reference image: the mean of the gaze (recording_id, i, ref_x, ref_y, status) that is valid and on the image; those without any are dropped, the rest is numbered anew."""
    on = f"g.status > 0 AND g.ref_x BETWEEN 0 AND {width} AND g.ref_y BETWEEN 0 AND {height}"
    p = p.then(f"{out}_c", f"SELECT e.recording_id, e.a, e.duration, avg(g.ref_x) AS x, avg(g.ref_y) AS y FROM {events} e JOIN {gaze} g ON e.recording_id = g.recording_id AND g.i BETWEEN e.a AND e.b WHERE {on} GROUP BY e.recording_id, e.a, e.duration")
    return p.then(out, f"SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a) - 1 AS BIGINT) AS k, x, y, duration AS dur FROM {out}_c")


def geometry(p: Plan, source: str, out: str, probability: float = 0.68) -> Plan:
    """Length (0 for one point), BCEA and K coefficient per recording."""
    p = p.then(f"{out}_s", f"SELECT *, sqrt(power(lead(x) OVER ({WK}) - x, 2) + power(lead(y) OVER ({WK}) - y, 2)) AS step FROM {source}")
    p = p.then(
        f"{out}_z",
        f"""SELECT *, (dur - avg(CASE WHEN step IS NOT NULL THEN dur END) OVER (PARTITION BY recording_id)) / nullif(stddev_pop(CASE WHEN step IS NOT NULL THEN dur END) OVER (PARTITION BY recording_id), 0) AS zd,
        (step - avg(step) OVER (PARTITION BY recording_id)) / nullif(stddev_pop(step) OVER (PARTITION BY recording_id), 0) AS zs FROM {out}_s""",
    )
    return p.then(
        out,
        f"""SELECT recording_id, count(*) AS n, {r6("coalesce(sum(step), 0.0)")} AS length, {r6(f"CASE WHEN count(*) > 1 THEN {bcea_sql(probability)} END")} AS bcea,
        {r6("abs(avg(CASE WHEN step IS NOT NULL THEN zd - zs END))")} AS k_coefficient FROM {out}_z GROUP BY recording_id""",
    )


def _lines(p: Plan, cells: str, out: str, key: str, place: str, shortest: int) -> Plan:
    """Lengths of runs of consecutive ``place`` for each value of ``key`` among recurrent cells."""
    p = p.then(f"{out}_g", f"SELECT recording_id, {key} AS line, {place} AS at, {place} - row_number() OVER (PARTITION BY recording_id, {key} ORDER BY {place}) AS g FROM {cells}")
    return p.then(out, f"SELECT recording_id, line, count(*) AS len FROM {out}_g GROUP BY recording_id, line, g HAVING count(*) >= {shortest}")


def recurrence(p: Plan, source: str, out: str, radius: float, shortest: int = 2) -> Plan:
    """Recurrence quantification per recording: rate, laminarity, determinism, centre of mass, entropy. Only pairs of one recording meet."""
    p = p.then(f"{out}_r", f"SELECT a.recording_id, a.k AS i, b.k AS j FROM {source} a JOIN {source} b ON a.recording_id = b.recording_id AND a.k < b.k WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) < {radius * radius}")
    p = p.then(f"{out}_n", f"SELECT recording_id, count(*) AS n FROM {source} GROUP BY recording_id")
    p = p.then(f"{out}_t", f"SELECT recording_id, count(*) AS rp, sum(j - i) AS mass FROM {out}_r GROUP BY recording_id")
    p = _lines(p, f"{out}_r", f"{out}_v", "i", "j", shortest)
    p = _lines(p, f"{out}_r", f"{out}_h", "j", "i", shortest)
    p = _lines(p, f"{out}_r", f"{out}_d", "j - i", "i", shortest)
    for name in "vhd":
        p = p.then(f"{out}_{name}s", f"SELECT recording_id, sum(len) AS total, count(*) AS n FROM {out}_{name} GROUP BY recording_id")
    p = p.then(f"{out}_c", f"SELECT recording_id, len, count(*) AS c FROM {out}_d GROUP BY recording_id, len")
    p = p.then(f"{out}_e", f"SELECT c.recording_id, -sum((c.c / CAST(d.n AS DOUBLE)) * ln(c.c / CAST(d.n AS DOUBLE))) AS entropy FROM {out}_c c JOIN {out}_ds d ON c.recording_id = d.recording_id GROUP BY c.recording_id")
    return p.then(
        out,
        f"""SELECT n.recording_id, {r6("2e2 * coalesce(t.rp, 0) / nullif(n.n * (n.n - 1), 0)")} AS recurrence_rate, {r6("5e1 * (coalesce(v.total, 0) + coalesce(h.total, 0)) / nullif(t.rp, 0)")} AS laminarity,
        {r6("1e2 * coalesce(d.total, 0) / nullif(t.rp, 0)")} AS determinism, {r6("1e2 * t.mass / nullif((n.n - 1) * t.rp, 0)")} AS corm, {r6("coalesce(e.entropy, 0.0)")} AS entropy
        FROM {out}_n n LEFT JOIN {out}_t t ON n.recording_id = t.recording_id LEFT JOIN {out}_vs v ON n.recording_id = v.recording_id LEFT JOIN {out}_hs h ON n.recording_id = h.recording_id
        LEFT JOIN {out}_ds d ON n.recording_id = d.recording_id LEFT JOIN {out}_e e ON n.recording_id = e.recording_id""",
    )


def cross_recurrence(p: Plan, source: str, pairs: str, out: str, radius: float, shortest: int = 3) -> Plan:
    """Recurrence between two recordings for the given pairs (id_1, id_2): rate, laminarity of either direction, determinism, entropy."""
    p = p.then(f"{out}_q", f"SELECT id_1, id_2, concat(CAST(id_1 AS VARCHAR(20)), '-', CAST(id_2 AS VARCHAR(20))) AS recording_id FROM {pairs}")
    p = p.then(f"{out}_r", f"SELECT q.recording_id, a.k AS i, b.k AS j FROM {out}_q q JOIN {source} a ON a.recording_id = q.id_1 JOIN {source} b ON b.recording_id = q.id_2 WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) < {radius * radius}")
    p = p.then(f"{out}_n", f"SELECT recording_id, count(*) AS n FROM {source} GROUP BY recording_id")
    p = p.then(f"{out}_t", f"SELECT recording_id, count(*) AS rp FROM {out}_r GROUP BY recording_id")
    p = _lines(p, f"{out}_r", f"{out}_v", "i", "j", shortest)
    p = _lines(p, f"{out}_r", f"{out}_h", "j", "i", shortest)
    p = _lines(p, f"{out}_r", f"{out}_d", "j - i", "i", shortest)
    for name in "vhd":
        p = p.then(f"{out}_{name}s", f"SELECT recording_id, sum(len) AS total, count(*) AS n FROM {out}_{name} GROUP BY recording_id")
    p = p.then(f"{out}_c", f"SELECT recording_id, len, count(*) AS c FROM {out}_d GROUP BY recording_id, len")
    p = p.then(f"{out}_e", f"SELECT c.recording_id, -sum((c.c / CAST(d.n AS DOUBLE)) * ln(c.c / CAST(d.n AS DOUBLE))) AS entropy FROM {out}_c c JOIN {out}_ds d ON c.recording_id = d.recording_id GROUP BY c.recording_id")
    return p.then(
        out,
        f"""SELECT q.id_1, q.id_2, {r6("1e2 * coalesce(t.rp, 0) / (n1.n * n2.n)")} AS recurrence_rate, {r6("1e2 * coalesce(v.total, 0) / nullif(t.rp, 0)")} AS laminarity_vertical, {r6("1e2 * coalesce(h.total, 0) / nullif(t.rp, 0)")} AS laminarity_horizontal,
        {r6("1e2 * coalesce(d.total, 0) / nullif(t.rp, 0)")} AS determinism, {r6("coalesce(e.entropy, 0.0)")} AS entropy
        FROM {out}_q q JOIN {out}_n n1 ON q.id_1 = n1.recording_id JOIN {out}_n n2 ON q.id_2 = n2.recording_id LEFT JOIN {out}_t t ON q.recording_id = t.recording_id LEFT JOIN {out}_vs v ON q.recording_id = v.recording_id
        LEFT JOIN {out}_hs h ON q.recording_id = h.recording_id LEFT JOIN {out}_ds d ON q.recording_id = d.recording_id LEFT JOIN {out}_e e ON q.recording_id = e.recording_id""",
    )


def saliency_map(p: Plan, source: str, out: str, width: float, height: float, kind: str = "count", nx: int = 25, ny: int = 25, sigma: float = 3.0, half: int = 6) -> Plan:
    """Dense map (by, bx, v) that sums to one: counts, durations or relative durations, smoothed by a separable Gaussian with zero padding."""
    value = {"count": "1e0", "absolute_duration": "dur", "relative_duration": "dur / nullif(sum(dur) OVER (PARTITION BY recording_id), 0)"}[kind]
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    p = p.then(f"{out}_k", " UNION ALL ".join(f"SELECT {k - half} AS d, {float(w / taps.sum())!r} AS w" for k, w in enumerate(taps)))
    p = p.then(f"{out}_b", f"SELECT CAST(floor(greatest(0.0, least(x, {width - 0.001})) / {width / nx}) AS BIGINT) AS gx, CAST(floor(greatest(0.0, least(y, {height - 0.001})) / {height / ny}) AS BIGINT) AS gy, {value} AS v FROM {source}")
    p = p.then(f"{out}_c", f"SELECT gx, gy, sum(v) AS v FROM {out}_b GROUP BY gx, gy")
    p = p.then(f"{out}_x", f"SELECT c.gx + k.d AS gx, c.gy, sum(c.v * k.w) AS v FROM {out}_c c CROSS JOIN {out}_k k WHERE c.gx + k.d BETWEEN 0 AND {nx - 1} GROUP BY c.gx + k.d, c.gy")
    p = p.then(f"{out}_y", f"SELECT c.gx, c.gy + k.d AS gy, sum(c.v * k.w) AS v FROM {out}_x c CROSS JOIN {out}_k k WHERE c.gy + k.d BETWEEN 0 AND {ny - 1} GROUP BY c.gx, c.gy + k.d")
    p = p.then(f"{out}_gx", f"SELECT @upto({nx}) AS c").then(f"{out}_gy", f"SELECT @upto({ny}) AS c")
    p = p.then(f"{out}_g", f"SELECT CAST(a.c - 1 AS BIGINT) AS gx, CAST(b.c - 1 AS BIGINT) AS gy FROM {out}_gx a CROSS JOIN {out}_gy b")
    return p.then(out, f"SELECT g.gx, g.gy, coalesce(y.v, 0.0) / sum(coalesce(y.v, 0.0)) OVER () AS v FROM {out}_g g LEFT JOIN {out}_y y ON g.gx = y.gx AND g.gy = y.gy")


def compare_maps(p: Plan, one: str, two: str, out: str, floor: float = 1e-12) -> Plan:
    """Pearson correlation and Kullback-Leibler divergence of two maps."""
    p = p.then(f"{out}_j", f"SELECT greatest(a.v, {floor}) AS a, greatest(b.v, {floor}) AS b FROM {one} a JOIN {two} b ON a.gx = b.gx AND a.gy = b.gy")
    return p.then(out, f"SELECT {r6('covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)')} AS pearson, {r6('sum(a * ln(a / b))')} AS kl_divergence FROM {out}_j")


def map_against_fixations(p: Plan, fixation_bins: str, smap: str, out: str, nx: int, ny: int, jitter: float = 0.0, seed: int = 0) -> Plan:
    """Per recording against a reference map: NSS, percentile, information gain over a centre Gaussian, AUC (Judd).

    With ``jitter`` the AUC ranks values to which each cell adds up to that much, by its place and ``seed``; without, equal values count half.
    """
    moved = f"v + {jitter!r} * ((gx * 7919 + gy * 104729 + {seed * 15485863}) % 1000003) / 1000003.0" if jitter else "v"
    gauss = f"exp(-0.5 * (power((gx - {(nx - 1) / 2}) / {nx / 4}, 2) + power((gy - {(ny - 1) / 2}) / {ny / 4}, 2)))"
    p = p.then(f"{out}_m", f"SELECT gx, gy, v, avg(v) OVER () AS mu, stddev_samp(v) OVER () AS sd, (rank() OVER (ORDER BY v) - 1) / CAST({nx * ny} AS DOUBLE) AS below, {gauss} / sum({gauss}) OVER () AS base, {moved} AS jv FROM {smap}")
    p = p.then(f"{out}_f", f"SELECT f.recording_id, f.gx, f.gy, m.jv AS v, (m.v - m.mu) / nullif(m.sd, 0) AS z, m.below, ln(greatest(m.v, 1e-12) / greatest(m.base, 1e-12)) / ln(2.0) AS gain FROM {fixation_bins} f JOIN {out}_m m ON f.gx = m.gx AND f.gy = m.gy")
    # AUC: each distinct fixated cell against all cells that are not fixated, ties count half
    p = p.then(f"{out}_d", f"SELECT DISTINCT recording_id, gx, gy, v FROM {out}_f")
    p = p.then(f"{out}_n", f"SELECT recording_id, count(*) AS n FROM {out}_d GROUP BY recording_id")
    p = p.then(f"{out}_q", f"SELECT d.recording_id, sum(CASE WHEN m.v < d.v THEN 1e0 WHEN m.v = d.v THEN 5e-1 ELSE 0e0 END) AS wins FROM {out}_d d CROSS JOIN (SELECT jv AS v FROM {out}_m) m GROUP BY d.recording_id")
    p = p.then(f"{out}_s", f"SELECT d.recording_id, sum(CASE WHEN e.v < d.v THEN 1e0 WHEN e.v = d.v THEN 5e-1 ELSE 0e0 END) AS own FROM {out}_d d JOIN {out}_d e ON d.recording_id = e.recording_id GROUP BY d.recording_id")
    p = p.then(f"{out}_g", f"SELECT recording_id, avg(z) AS nss, avg(below) AS percentile, avg(gain) AS gain FROM {out}_f GROUP BY recording_id")
    return p.then(out, f"SELECT g.recording_id, {r6('g.nss')} AS nss, {r6('100 * g.percentile')} AS percentile, {r6('g.gain')} AS information_gain, {r6(f'(q.wins - s.own) / nullif(n.n * ({nx * ny} - n.n), 0)')} AS auc FROM {out}_g g JOIN {out}_n n ON g.recording_id = n.recording_id JOIN {out}_q q ON g.recording_id = q.recording_id JOIN {out}_s s ON g.recording_id = s.recording_id")


def nss_with_tolerance(p: Plan, fixation_bins: str, smap: str, out: str, sigma: float = 0.5, reach: int = 1) -> Plan:
    """Per recording the mean z-score of a map at its fixated cells, smoothed by a Gaussian over ``reach`` cells to each side (zero beyond the map), and the gain over a uniform map in bits."""
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    kernel = " UNION ALL ".join(f"SELECT {i} AS ox, {j} AS oy, {float(weight[i + reach] * weight[j + reach])!r} AS w" for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))
    p = p.then(f"{out}_k", kernel).then(f"{out}_z", f"SELECT gx, gy, v, count(*) OVER () AS cells, (v - avg(v) OVER ()) / nullif(stddev_samp(v) OVER (), 0) AS z FROM {smap}")
    p = p.then(f"{out}_c", f"SELECT m.gx + k.ox AS gx, m.gy + k.oy AS gy, sum(m.z * k.w) AS z, max(CASE WHEN k.ox = 0 AND k.oy = 0 THEN ln(greatest(m.v, 1e-12) * m.cells) / ln(2.0) END) AS gain FROM {out}_z m CROSS JOIN {out}_k k GROUP BY m.gx + k.ox, m.gy + k.oy")
    return p.then(out, f"SELECT f.recording_id, {r6('avg(c.z)')} AS nss, {r6('avg(c.gain)')} AS information_gain FROM {fixation_bins} f JOIN {out}_c c ON f.gx = c.gx AND f.gy = c.gy GROUP BY f.recording_id")


def point_mapping(p: Plan, source: str, pairs: str, out: str) -> Plan:
    """Nearest-point mapping of each pair both ways and the eye analysis distance."""
    p = p.then(f"{out}_d", f"SELECT q.id_1, q.id_2, a.k AS i, b.k AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM {pairs} q JOIN {source} a ON a.recording_id = q.id_1 JOIN {source} b ON b.recording_id = q.id_2")
    p = p.then(f"{out}_1", f"SELECT id_1, id_2, i, min(d) AS d FROM {out}_d GROUP BY id_1, id_2, i").then(f"{out}_2", f"SELECT id_1, id_2, j, min(d) AS d FROM {out}_d GROUP BY id_1, id_2, j")
    p = p.then(f"{out}_a", f"SELECT id_1, id_2, sum(d) AS s, sum(d * d) AS s2, count(*) AS n FROM {out}_1 GROUP BY id_1, id_2").then(f"{out}_b", f"SELECT id_1, id_2, sum(d) AS s, sum(d * d) AS s2, count(*) AS n FROM {out}_2 GROUP BY id_1, id_2")
    return p.then(out, f"SELECT a.id_1, a.id_2, {r6('(a.s + b.s) / greatest(a.n, b.n)')} AS eye_analysis_distance, {r6('sqrt((b.n * a.s2 + a.n * b.s2) / (2.0 * a.n * b.n))')} AS linear_distance FROM {out}_a a JOIN {out}_b b ON a.id_1 = b.id_1 AND a.id_2 = b.id_2")


def time_delay_embedding(p: Plan, source: str, pairs: str, out: str, k: int = 5) -> Plan:
    """Distance of each run of ``k`` points of the first scanpath to the nearest run of the second: mean and largest, scaled by the pair's largest coordinate."""
    cols = ", ".join(f"lead(x, {m}) OVER ({WK}) AS x{m}, lead(y, {m}) OVER ({WK}) AS y{m}" for m in range(k))
    p = p.then(f"{out}_u", f"SELECT * FROM (SELECT recording_id, k, {cols} FROM {source}) q WHERE x{k - 1} IS NOT NULL")
    p = p.then(f"{out}_m", f"SELECT recording_id, greatest(max(x), max(y)) AS top FROM {source} GROUP BY recording_id")
    d = " + ".join(f"power(a.x{m} - b.x{m}, 2) + power(a.y{m} - b.y{m}, 2)" for m in range(k))
    p = p.then(f"{out}_d", f"SELECT q.id_1, q.id_2, a.k, min(sqrt({d})) AS d FROM {pairs} q JOIN {out}_u a ON a.recording_id = q.id_1 JOIN {out}_u b ON b.recording_id = q.id_2 GROUP BY q.id_1, q.id_2, a.k")
    return p.then(out, f"SELECT d.id_1, d.id_2, {r6('avg(d.d) / nullif(max(greatest(m1.top, m2.top)), 0)')} AS mean_minimal, {r6('max(d.d) / nullif(max(greatest(m1.top, m2.top)), 0)')} AS hausdorff FROM {out}_d d JOIN {out}_m m1 ON d.id_1 = m1.recording_id JOIN {out}_m m2 ON d.id_2 = m2.recording_id GROUP BY d.id_1, d.id_2")


def subsequence_similarity(p: Plan, symbols: str, pairs: str, out: str, n: int = 3) -> Plan:
    """One less half the difference of the n-gram frequency tables of two symbol sequences (recording_id, k, s)."""
    gram = "concat(" + ", ',', ".join(f"lead(s, {m}) OVER ({WK})" for m in range(n)) + ")"
    p = p.then(f"{out}_g", f"SELECT recording_id, g, CASE WHEN l IS NULL THEN 0 ELSE 1 END AS ok FROM (SELECT recording_id, {gram} AS g, lead(s, {n - 1}) OVER ({WK}) AS l FROM {symbols}) q")
    p = p.then(f"{out}_f", f"SELECT recording_id, g, count(*) / CAST(sum(count(*)) OVER (PARTITION BY recording_id) AS DOUBLE) AS f FROM {out}_g WHERE ok = 1 GROUP BY recording_id, g")
    p = p.then(f"{out}_a", f"SELECT q.id_1, q.id_2, f.g, f.f AS f1, 0.0 AS f2 FROM {pairs} q JOIN {out}_f f ON f.recording_id = q.id_1 UNION ALL SELECT q.id_1, q.id_2, f.g, 0.0 AS f1, f.f AS f2 FROM {pairs} q JOIN {out}_f f ON f.recording_id = q.id_2")
    p = p.then(f"{out}_s", f"SELECT id_1, id_2, g, abs(sum(f1) - sum(f2)) AS d FROM {out}_a GROUP BY id_1, id_2, g")
    return p.then(out, f"SELECT id_1, id_2, {r6('1 - 0.5 * sum(d)')} AS similarity FROM {out}_s GROUP BY id_1, id_2")
