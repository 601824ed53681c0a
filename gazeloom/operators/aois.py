"""Areas of interest: sequences (recording_id, k, aoi, dur), their metrics, Markov statistics and patterns."""

from __future__ import annotations

from ..functions.relational import Plan, bcea_sql, r6

WK = "PARTITION BY recording_id ORDER BY k"


def predefined(p: Plan, points: str, rectangles: str, out: str, fewest: int = 1) -> Plan:
    """AoI of each point by rectangles (aoi, idx, x0, y0, x1, y1); of overlapping ones the last; points outside are dropped.

    In each recording only rectangles with ``fewest`` points or more count; points of others go to the next rectangle that holds them.
    """
    if fewest > 1:
        inside = f"SELECT s.recording_id, s.k, s.x, s.y, s.dur, r.aoi, r.idx, count(*) OVER (PARTITION BY s.recording_id, r.idx) AS held FROM {points} s JOIN {rectangles} r ON s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1"
        p = p.then(f"{out}_i", inside).then(f"{out}_l", f"SELECT *, row_number() OVER (PARTITION BY recording_id, k ORDER BY idx DESC) AS r FROM {out}_i WHERE held >= {fewest}")
        return p.then(out, f"SELECT recording_id, k, x, y, dur, aoi FROM {out}_l WHERE r = 1")
    p = p.then(f"{out}_j", f"SELECT s.recording_id, s.k, s.x, s.y, s.dur, max(r.idx) AS idx FROM {points} s JOIN {rectangles} r ON s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 GROUP BY s.recording_id, s.k, s.x, s.y, s.dur")
    return p.then(out, f"SELECT j.recording_id, j.k, j.x, j.y, j.dur, r.aoi FROM {out}_j j JOIN {rectangles} r ON j.idx = r.idx")


def center_distances(p: Plan, centers: str, out: str) -> Plan:
    """(recording_id, a, b, d, share): distance of each two centres (recording_id, aoi, cx, cy) of a recording, and its share of the largest."""
    p = p.then(f"{out}_d", f"SELECT a.recording_id, a.aoi AS a, b.aoi AS b, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS d FROM {centers} a JOIN {centers} b ON a.recording_id = b.recording_id")
    return p.then(out, f"SELECT recording_id, a, b, {r6('d')} AS d, {r6('d / nullif(max(d) OVER (PARTITION BY recording_id), 0)')} AS share FROM {out}_d")


def nearest_center(p: Plan, points: str, centers: str, out: str) -> Plan:
    """AoI of each point by the nearest centre (aoi, cx, cy); ties go to the first name."""
    p = p.then(f"{out}_d", f"SELECT s.recording_id, s.k, s.x, s.y, s.dur, c.aoi, row_number() OVER (PARTITION BY s.recording_id, s.k ORDER BY power(s.x - c.cx, 2) + power(s.y - c.cy, 2), c.aoi) AS r FROM {points} s CROSS JOIN {centers} c")
    return p.then(out, f"SELECT recording_id, k, x, y, dur, aoi FROM {out}_d WHERE r = 1")


def merge_small(p: Plan, points: str, out: str, fewest: int) -> Plan:
    """AoIs with fewer than ``fewest`` fixations join the nearest larger one; names are dealt anew in order (A, B, ...)."""
    p = p.then(f"{out}_c", f"SELECT aoi, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM {points} GROUP BY aoi")
    p = p.then(f"{out}_d", f"SELECT s.aoi, t.aoi AS target, row_number() OVER (PARTITION BY s.aoi ORDER BY power(s.cx - t.cx, 2) + power(s.cy - t.cy, 2), t.aoi) AS r FROM {out}_c s CROSS JOIN {out}_c t WHERE t.n >= {fewest}")
    p = p.then(f"{out}_m", f"SELECT aoi, target, dense_rank() OVER (ORDER BY target) - 1 AS place FROM {out}_d WHERE r = 1")
    return p.then(out, f"SELECT p.recording_id, p.k, p.x, p.y, p.dur, @letter(m.place) AS aoi FROM {points} p JOIN {out}_m m ON p.aoi = m.aoi")


def collapse(p: Plan, seq: str, out: str) -> Plan:
    """Runs of one AoI become one visit with the summed duration."""
    p = p.then(f"{out}_f", f"SELECT *, CASE WHEN lag(aoi) OVER ({WK}) = aoi THEN 0 ELSE 1 END AS is_new FROM {seq}")
    p = p.then(f"{out}_g", f"SELECT *, sum(is_new) OVER ({WK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {out}_f")
    return p.then(out, f"SELECT recording_id, CAST(g - 1 AS BIGINT) AS k, aoi, sum(dur) AS dur FROM {out}_g GROUP BY recording_id, g, aoi")


def temporal_binning(p: Plan, seq: str, out: str, step: float) -> Plan:
    """Each visit repeated once for every started ``step`` seconds; the last repeat has the remainder."""
    p = p.then(f"{out}_r", f"SELECT recording_id, k, aoi, dur, @upto(greatest(1, ceil(dur / {step} - 1e-9))) AS r FROM {seq}")
    return p.then(out, f"SELECT recording_id, k, r, aoi, CASE WHEN r = greatest(1, ceil(dur / {step} - 1e-9)) THEN dur - {step} * (r - 1) ELSE {step} END AS dur FROM {out}_r")


def durations(p: Plan, seq: str, out: str) -> Plan:
    """Dwell per AoI: total, mean, population deviation, share of the recording; and the number of AoIs."""
    p = p.then(f"{out}_d", f"SELECT recording_id, aoi, sum(dur) AS total, avg(dur) AS mean, stddev_pop(dur) AS sd FROM {seq} GROUP BY recording_id, aoi")
    return p.then(out, f"SELECT recording_id, aoi, {r6('total')} AS dwell, {r6('mean')} AS mean_duration, {r6('sd')} AS sd_duration, {r6('total / nullif(sum(total) OVER (PARTITION BY recording_id), 0)')} AS proportion, count(*) OVER (PARTITION BY recording_id) AS n_aoi FROM {out}_d")


def bcea(p: Plan, points: str, out: str, probability: float = 0.68) -> Plan:
    """BCEA per AoI and recording: mean, mean absolute deviation from the median, dwell-weighted sum."""
    p = p.then(f"{out}_a", f"SELECT recording_id, aoi, sum(dur) AS dur, {bcea_sql(probability)} AS bcea FROM {points} GROUP BY recording_id, aoi HAVING count(*) > 1")
    p = p.then(f"{out}_m", f"SELECT recording_id, median(bcea) AS med FROM {out}_a GROUP BY recording_id")
    return p.then(out, f"SELECT a.recording_id, {r6('avg(a.bcea)')} AS mean_bcea, {r6('avg(abs(a.bcea - m.med))')} AS dispersion, {r6('sum(a.bcea * a.dur) / nullif(sum(a.dur), 0)')} AS weighted_bcea FROM {out}_a a JOIN {out}_m m ON a.recording_id = m.recording_id GROUP BY a.recording_id")


def ellipses(p: Plan, points: str, out: str) -> Plan:
    """Centre and covariance of the points of each AoI and recording (0 for one point), from which its ellipse is drawn."""
    spread = ", ".join(f"{r6(f'coalesce({f}, 0.0)')} AS {n}" for f, n in (("var_samp(x)", "var_x"), ("covar_samp(x, y)", "cov_xy"), ("var_samp(y)", "var_y")))
    return p.then(out, f"SELECT recording_id, aoi, count(*) AS n, {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy, {spread} FROM {points} GROUP BY recording_id, aoi")


def chord_edges(p: Plan, transitions: str, out: str) -> Plan:
    """Edges of a chord diagram: transitions weighted by whole hundred-thousandths of their probability."""
    return p.then(out, f"SELECT recording_id, src, dst, CAST(floor(p * 1e5) AS BIGINT) AS weight FROM {transitions} WHERE p > 0")


def transitions(p: Plan, seq: str, out: str) -> Plan:
    """(recording_id, src, dst, n, p): observed transitions; rows of p sum to one."""
    p = p.then(f"{out}_l", f"SELECT recording_id, aoi AS src, lead(aoi) OVER ({WK}) AS dst FROM {seq}")
    return p.then(out, f"SELECT recording_id, src, dst, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY recording_id, src) AS DOUBLE) AS p FROM {out}_l WHERE dst IS NOT NULL GROUP BY recording_id, src, dst")


def ngrams(p: Plan, seq: str, out: str, n: int = 3) -> Plan:
    """Relative frequency of each run of ``n`` AoIs."""
    gram = "concat(" + ", ".join(f"lead(aoi, {m}) OVER ({WK}), ','" for m in range(n)) + ")"
    p = p.then(f"{out}_g", f"SELECT recording_id, {gram} AS gram, lead(aoi, {n - 1}) OVER ({WK}) AS last_ FROM {seq}")
    return p.then(out, f"SELECT recording_id, gram, count(*) AS n, {r6('count(*) / CAST(sum(count(*)) OVER (PARTITION BY recording_id) AS DOUBLE)')} AS frequency FROM {out}_g WHERE last_ IS NOT NULL GROUP BY recording_id, gram")


def sequential_pairs(p: Plan, seq: str, out: str, support: float = 0.5) -> Plan:
    """Patterns of length one and two (a ... b, gaps allowed) in at least ``support`` of the collapsed sequences."""
    p = collapse(p, seq, f"{out}_c")
    p = p.then(f"{out}_t", f"SELECT count(DISTINCT recording_id) AS total FROM {out}_c")
    p = p.then(f"{out}_o", f"SELECT recording_id, aoi, min(k) AS lo, max(k) AS hi FROM {out}_c GROUP BY recording_id, aoi")
    # a before b somewhere: the first a comes before the last b
    p = p.then(f"{out}_p", f"SELECT a.recording_id, concat(a.aoi, ',', b.aoi) AS pattern, 2 AS len FROM {out}_o a JOIN {out}_o b ON a.recording_id = b.recording_id AND a.lo < b.hi UNION ALL SELECT recording_id, aoi AS pattern, 1 AS len FROM {out}_o")
    return p.then(out, f"SELECT p.pattern, p.len, count(*) AS support, {r6('count(*) / CAST(max(t.total) AS DOUBLE)')} AS share FROM {out}_p p CROSS JOIN {out}_t t GROUP BY p.pattern, p.len HAVING count(*) >= greatest(1, ceil({support} * max(t.total)))")


def trend(p: Plan, seq: str, out: str, tolerance: float = 0.95) -> Plan:
    """Trend analysis: instances of each AoI by duration, those shared by ``tolerance`` of recordings, ordered by mean priority.

    Ties of duration go to the earlier visit. An unshared instance stays if it occurs at least as often and long as the rarest shared one.
    """
    p = collapse(p, seq, f"{out}_c")
    p = p.then(f"{out}_n", f"SELECT *, row_number() OVER (PARTITION BY recording_id, aoi ORDER BY dur DESC, k) AS inst, count(*) OVER (PARTITION BY recording_id) AS len FROM {out}_c")
    p = p.then(f"{out}_p", f"SELECT *, 1 - k * 0.9 / greatest(1, len - 1) AS psi FROM {out}_n")
    p = p.then(f"{out}_t", f"SELECT count(DISTINCT recording_id) AS total FROM {out}_c")
    p = p.then(f"{out}_s", f"SELECT aoi, inst, count(*) AS n, sum(dur) AS dur, sum(psi) AS psi FROM {out}_p GROUP BY aoi, inst")
    p = p.then(f"{out}_h", f"SELECT min(s.n) AS least_n, min(s.dur) AS least_dur FROM {out}_s s CROSS JOIN {out}_t t WHERE s.n >= {tolerance} * t.total")
    return p.then(out, f"SELECT CAST(row_number() OVER (ORDER BY s.psi DESC, s.dur DESC, s.n DESC, s.aoi, s.inst) AS BIGINT) AS place, s.aoi, CAST(s.inst AS BIGINT) AS inst, s.n, {r6('s.dur')} AS dur, {r6('s.psi')} AS priority FROM {out}_s s CROSS JOIN {out}_h h WHERE s.n >= h.least_n AND s.dur >= h.least_dur")


def scarf(p: Plan, seq: str, out: str) -> Plan:
    """Start and end of each visit by cumulated durations."""
    return p.then(out, f"SELECT recording_id, k, aoi, {r6(f'sum(dur) OVER ({WK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - dur')} AS start_s, {r6(f'sum(dur) OVER ({WK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS end_s FROM {seq}")


def sankey(p: Plan, seq: str, out: str, parts: int = 9) -> Plan:
    """Shares of recordings that go from one AoI to another between consecutive parts of the sequence; a part's AoI is its most frequent, ties to the first name."""
    p = p.then(f"{out}_b", f"SELECT recording_id, aoi, CAST(floor(k * {parts} / count(*) OVER (PARTITION BY recording_id)) AS BIGINT) AS part FROM {seq}")
    p = p.then(f"{out}_c", f"SELECT recording_id, part, aoi, row_number() OVER (PARTITION BY recording_id, part ORDER BY count(*) DESC, aoi) AS r FROM {out}_b GROUP BY recording_id, part, aoi")
    p = p.then(f"{out}_n", f"SELECT recording_id, part, aoi AS src, lead(aoi) OVER (PARTITION BY recording_id ORDER BY part) AS dst FROM {out}_c WHERE r = 1")
    p = p.then(f"{out}_t", f"SELECT count(DISTINCT recording_id) AS total FROM {seq}")
    return p.then(out, f"SELECT n.part, n.src, n.dst, {r6('count(*) / CAST(max(t.total) AS DOUBLE)')} AS share FROM {out}_n n CROSS JOIN {out}_t t WHERE n.dst IS NOT NULL GROUP BY n.part, n.src, n.dst")


def transition_flow(p: Plan, seq: str, out: str, layers: int = 4) -> Plan:
    """Mean relative position of each AoI, its layer, and the forward transitions out of it."""
    p = p.then(f"{out}_r", f"SELECT recording_id, aoi, k / CAST(greatest(1, count(*) OVER (PARTITION BY recording_id) - 1) AS DOUBLE) AS pos, lead(aoi) OVER ({WK}) AS dst FROM {seq}")
    p = p.then(f"{out}_m", f"SELECT aoi, avg(pos) AS pos FROM {out}_r GROUP BY aoi")
    return p.then(out, f"SELECT r.aoi AS src, r.dst, {r6('max(a.pos)')} AS src_pos, {r6('max(b.pos)')} AS dst_pos, CAST(least({layers - 1}, floor(max(a.pos) * {layers})) AS BIGINT) AS layer, count(*) AS n FROM {out}_r r JOIN {out}_m a ON r.aoi = a.aoi JOIN {out}_m b ON r.dst = b.aoi WHERE a.pos < b.pos GROUP BY r.aoi, r.dst")
