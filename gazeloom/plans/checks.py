"""SQL for kernel queries, each written another way than its kernel: closures for trees, orthogonal polynomials for fits, plain sums for spectra."""

from __future__ import annotations

from ..functions.relational import Plan
from ..operators import grouped
from . import catalog as C

#: Rounding that sums in another order survive.
FOUR = "floor(({0}) * 1e4 + 0.5001) / 1e4"


def recursive(plan: Plan) -> str:
    """A plan in DuckDB's dialect that may have recursive relations."""
    return plan.duckdb().replace("WITH ", "WITH RECURSIVE ", 1)


def two_classes(p: Plan, limits: dict) -> Plan:
    """Labels of two classes after ``raw`` (recording_id, i, status, scan)."""
    return grouped.two_class(p, "raw", "lab", "scan = 1", C.FS, **limits).then("out", "SELECT recording_id, i, label FROM lab")


def spanning_tree(limits: dict, window: int, eps: float, min_points: int) -> str:
    """I-MST by reachability: what a tree without long edges holds together is what short steps reach."""
    p = C.KIN.then("sized", "SELECT recording_id, i, x, y, count(*) OVER (PARTITION BY recording_id) AS n FROM kin")
    p = p.then("starts", f"SELECT recording_id, unnest(range(0, greatest(1, n - {window} + 1), {max(1, window // 2)})) AS a FROM (SELECT DISTINCT recording_id, n FROM sized) q")
    p = p.then("inside", f"SELECT t.recording_id, t.a, s.i, s.x, s.y FROM starts t JOIN sized s ON s.recording_id = t.recording_id AND s.i >= t.a AND s.i < t.a + {window}")
    p = p.then("near", f"SELECT l.recording_id, l.a, l.i, r.i AS j FROM inside l JOIN inside r ON l.recording_id = r.recording_id AND l.a = r.a AND sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) < {eps}")
    p = p.then("reach", "SELECT recording_id, a, i, j FROM near UNION SELECT r.recording_id, r.a, r.i, n.j FROM reach r JOIN near n ON n.recording_id = r.recording_id AND n.a = r.a AND n.i = r.j")
    p = p.then("votes", f"SELECT recording_id, i, avg(CASE WHEN c >= {min_points} THEN 1 ELSE 0 END) AS share FROM (SELECT recording_id, a, i, count(*) AS c FROM reach GROUP BY recording_id, a, i) q GROUP BY recording_id, i")
    p = p.then("raw", "SELECT k.recording_id, k.i, k.status, CASE WHEN v.share >= 0.5 THEN 1 ELSE 0 END AS scan FROM kin k LEFT JOIN votes v ON v.recording_id = k.recording_id AND v.i = k.i")
    return recursive(two_classes(p, limits))


def fluctuation(scales: list[int], overlap: bool) -> str:
    """Detrended fluctuation with parabolas: what a segment leaves beyond its parts along the orthogonal polynomials of degree 0 to 2."""
    p = C.KIN.then("sized", "SELECT recording_id, i, x, y, count(*) OVER (PARTITION BY recording_id) AS n FROM kin")
    p = p.then("scales", f"SELECT unnest({scales}) AS w")
    step = "greatest(1, w // 2)" if overlap else "w"
    p = p.then("starts", f"SELECT recording_id, n, w, unnest(range(0, n - w + 1, {step})) AS a FROM (SELECT DISTINCT recording_id, n FROM sized) q CROSS JOIN scales")
    p = p.then("parts", "SELECT recording_id, w, a, 0 AS side, a AS s FROM starts UNION ALL SELECT recording_id, w, a, 1 AS side, n - w - a AS s FROM starts")
    p = p.then("cut", "SELECT p.recording_id, p.w, p.a, p.side, k.x, k.y, k.i - p.s - (p.w - 1) / 2e0 AS t FROM parts p JOIN sized k ON k.recording_id = p.recording_id AND k.i >= p.s AND k.i < p.s + p.w")
    left = "sum({0} * {0}) - power(sum({0}), 2) / w - power(sum({0} * t), 2) / (w * (w * w - 1) / 12e0) - power(sum({0} * (t * t - (w * w - 1) / 12e0)), 2) / (w * (w * w - 1) * (w * w - 4) / 180e0)"
    p = p.then("fits", f"SELECT recording_id, w, {left.format('x')} AS rx, {left.format('y')} AS ry FROM cut GROUP BY recording_id, w, a, side")
    p = p.then("flux", "SELECT recording_id, w, sqrt(greatest(sum(rx), 0) / (count(*) * w)) AS x, sqrt(greatest(sum(ry), 0) / (count(*) * w)) AS y FROM fits GROUP BY recording_id, w")
    slope = lambda c: FOUR.format(f"CASE WHEN count(*) FILTER (WHERE f.{c} > 0) > 1 THEN regr_slope(ln(f.{c}), ln(f.w)) FILTER (WHERE f.{c} > 0) END") + f" AS hurst_{c}"
    return p.then("out", f"SELECT s.recording_id, {slope('x')}, {slope('y')} FROM (SELECT DISTINCT recording_id FROM sized) s LEFT JOIN flux f ON f.recording_id = s.recording_id GROUP BY s.recording_id").duckdb()


def cross_spectra(segment: int | None) -> str:
    """Cross spectra as sums over cosines and sines, once for each recording, padded length and place, then joined by pairs."""
    size = f"least({segment}, n)" if segment else "n"
    taper = "(0.5 - 0.5 * cos(2 * pi() * j / m))"
    p = C.KIN.then("lens", "SELECT recording_id, count(*) AS len FROM kin GROUP BY recording_id")
    p = p.then("pairs", f"SELECT *, CAST({size} AS BIGINT) AS m FROM (SELECT a.recording_id AS id_1, b.recording_id AS id_2, greatest(a.len, b.len) AS n FROM lens a JOIN lens b ON a.recording_id < b.recording_id) q")
    p = p.then("tops", "SELECT recording_id, m, max(n) AS n FROM (SELECT id_1 AS recording_id, m, n FROM pairs UNION ALL SELECT id_2, m, n FROM pairs) q GROUP BY recording_id, m")
    p = p.then("places", "SELECT recording_id, m, unnest(range(0, n - m + 1, m - m // 2)) AS a FROM tops")
    p = p.then("grid", "SELECT recording_id, m, a, unnest(range(0, m)) AS j FROM places")
    p = p.then("cut", "SELECT g.recording_id, g.m, g.a, g.j, coalesce(k.x, 0) - avg(coalesce(k.x, 0)) OVER (PARTITION BY g.recording_id, g.m, g.a) AS v FROM grid g LEFT JOIN kin k ON k.recording_id = g.recording_id AND k.i = g.a + g.j")
    p = p.then("waves", f"SELECT recording_id, m, a, cell, sum(v * {taper} * cos(2 * pi() * cell * j / m)) AS c, sum(v * {taper} * sin(2 * pi() * cell * j / m)) AS s FROM (SELECT *, unnest(range(0, m // 2 + 1)) AS cell FROM cut) q GROUP BY recording_id, m, a, cell")
    both = "SELECT p.id_1, p.id_2, p.n, p.m, w.a, w.cell, {0} FROM pairs p JOIN waves w ON w.recording_id = p.{1} AND w.m = p.m AND w.a <= p.n - p.m"
    p = p.then("met", f"{both.format('w.c AS c1, w.s AS s1, 0e0 AS c2, 0e0 AS s2', 'id_1')} UNION ALL {both.format('0e0, 0e0, w.c, w.s', 'id_2')}")
    p = p.then("ones", "SELECT id_1, id_2, n, m, a, cell, sum(c1) AS c1, sum(s1) AS s1, sum(c2) AS c2, sum(s2) AS s2 FROM met GROUP BY id_1, id_2, n, m, a, cell")
    p = p.then("tapers", f"SELECT m, sum(power({taper}, 2)) AS t2 FROM (SELECT m, unnest(range(0, m)) AS j FROM (SELECT DISTINCT m FROM pairs) q) r GROUP BY m")
    p = p.then("sums", "SELECT id_1, id_2, n, m, cell, sum(c1 * c2 + s1 * s2) AS re, sum(s1 * c2 - c1 * s2) AS im, sum(c1 * c1 + s1 * s1) AS px, sum(c2 * c2 + s2 * s2) AS py FROM ones GROUP BY id_1, id_2, n, m, cell")
    p = p.then("scaled", f"SELECT s.*, CASE WHEN cell = 0 OR cell * 2 = s.m THEN 1 ELSE 2 END / ({C.FS} * t2 * ((n - s.m) // (s.m - s.m // 2) + 1)) AS f FROM sums s JOIN tapers t ON t.m = s.m")
    coherency = ", floor(f * f * (re * re + im * im) / (f * f * px * py + 1e-30) * 1e4 + 0.5) / 1e4 AS coherency" if segment else ""
    return p.then("out", f"SELECT id_1, id_2, CAST(cell AS BIGINT) AS cell, floor(cell * {C.FS} / m * 1e6 + 0.5) / 1e6 AS frequency, floor(re * f * 10 + 0.5) / 10 AS re, floor(im * f * 10 + 0.5) / 10 AS im{coherency} FROM scaled").duckdb()


def _density_clusters(eps: float, fewest: int) -> Plan:
    """``labelled`` (recording_id, k, x, y, dur, label): closures over core points; label null for noise."""
    p = C.PATH.then("near", f"SELECT l.recording_id, l.k, r.k AS j FROM path l JOIN path r ON l.recording_id = r.recording_id AND sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) <= {eps!r}")
    p = p.then("cores", f"SELECT recording_id, k FROM near GROUP BY recording_id, k HAVING count(*) >= {fewest}")
    p = p.then("steps", "SELECT n.recording_id, n.k, n.j FROM near n JOIN cores c ON c.recording_id = n.recording_id AND c.k = n.j")
    p = p.then("reach", "SELECT recording_id, k, k AS j FROM cores UNION SELECT r.recording_id, r.k, s.j FROM reach r JOIN steps s ON s.recording_id = r.recording_id AND s.k = r.j")
    p = p.then("numbered", "SELECT recording_id, k, dense_rank() OVER (PARTITION BY recording_id ORDER BY root) - 1 AS label FROM (SELECT recording_id, k, min(j) AS root FROM reach GROUP BY recording_id, k) q")
    p = p.then("touched", "SELECT s.recording_id, s.k, min(n.label) AS label FROM steps s JOIN numbered n ON n.recording_id = s.recording_id AND n.k = s.j GROUP BY s.recording_id, s.k")
    return p.then("labelled", "SELECT p.recording_id, p.k, p.x, p.y, coalesce(n.label, t.label) AS label FROM path p LEFT JOIN numbered n ON n.recording_id = p.recording_id AND n.k = p.k LEFT JOIN touched t ON t.recording_id = p.recording_id AND t.k = p.k")


#: Names of areas by number, for up to 26 in a recording.
_NAMED = "SELECT recording_id, k, chr(CAST(65 + label AS INTEGER)) AS aoi FROM {0} WHERE label IS NOT NULL"


def density(eps: float, fewest: int = 5, noise_too: bool = False) -> str:
    """DBSCAN by closures; with ``noise_too`` the rest goes to the nearest centre."""
    p = _density_clusters(eps, fewest)
    if noise_too:
        p = p.then("centres", "SELECT recording_id, label, avg(x) AS cx, avg(y) AS cy FROM labelled WHERE label IS NOT NULL GROUP BY recording_id, label")
        p = p.then("moved", "SELECT l.recording_id, l.k, coalesce(min(l.label), arg_min(c.label, power(l.x - c.cx, 2) + power(l.y - c.cy, 2))) AS label FROM labelled l LEFT JOIN centres c ON c.recording_id = l.recording_id GROUP BY l.recording_id, l.k")
    return recursive(p.then("out", _NAMED.format("moved" if noise_too else "labelled")))


def merged_areas(eps: float, fewest: int, least: int) -> str:
    """DBSCAN whose areas of fewer than ``least`` fixations join the nearest larger one, with centres."""
    p = _density_clusters(eps, fewest)
    p = p.then("centres", "SELECT recording_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM labelled WHERE label IS NOT NULL GROUP BY recording_id, label")
    p = p.then("large", f"SELECT recording_id, label AS target, cx AS tx, cy AS ty FROM centres WHERE n >= {least}")
    p = p.then("moves", "SELECT c.recording_id, c.label, coalesce(arg_min(l.target, power(cx - tx, 2) + power(cy - ty, 2)), c.label) AS target FROM centres c LEFT JOIN large l ON l.recording_id = c.recording_id GROUP BY c.recording_id, c.label")
    p = p.then("joined", "SELECT l.recording_id, l.k, l.x, l.y, m.target AS label FROM labelled l JOIN moves m ON m.recording_id = l.recording_id AND m.label = l.label")
    middle = lambda c: FOUR.format(f"avg({c}) OVER (PARTITION BY recording_id, label)") + f" AS c{c}"
    return recursive(p.then("out", f"SELECT recording_id, k, chr(CAST(65 + label AS INTEGER)) AS aoi, {middle('x')}, {middle('y')} FROM joined"))


def peaks(radius: float) -> str:
    """Density peaks by a join of all pairs of a recording."""
    p = C.PATH.then("pairs", "SELECT l.recording_id, l.k, r.k AS j, sqrt(power(l.x - r.x, 2) + power(l.y - r.y, 2)) AS d FROM path l JOIN path r ON l.recording_id = r.recording_id")
    p = p.then("dense", f"SELECT recording_id, k, round(sum(exp(-power(d / {radius!r}, 2))) - 1, 9) AS rho FROM pairs GROUP BY recording_id, k")
    p = p.then("apart", "SELECT p.recording_id, p.k, max(a.rho) AS rho, coalesce(min(d) FILTER (WHERE b.rho > a.rho), max(d)) AS delta FROM pairs p JOIN dense a ON a.recording_id = p.recording_id AND a.k = p.k JOIN dense b ON b.recording_id = p.recording_id AND b.k = p.j GROUP BY p.recording_id, p.k")
    p = p.then("cuts", "SELECT recording_id, coalesce(exp(sum(g * ln(g)) FILTER (WHERE g > 0) / sum(g) FILTER (WHERE g > 0)), 0) AS cut FROM (SELECT recording_id, CASE WHEN rho * delta > 0 THEN rho * delta END AS g FROM apart) q GROUP BY recording_id")
    p = p.then("centres", "SELECT a.recording_id, a.k, row_number() OVER (PARTITION BY a.recording_id ORDER BY a.k) - 1 AS label FROM apart a JOIN cuts c ON c.recording_id = a.recording_id WHERE rho * delta > cut")
    p = p.then("nearest", "SELECT p.recording_id, p.k, coalesce(arg_min(c.label, (d, c.label)) FILTER (WHERE c.label IS NOT NULL), 0) AS label FROM pairs p LEFT JOIN centres c ON c.recording_id = p.recording_id AND c.k = p.j GROUP BY p.recording_id, p.k")
    return p.then("out", _NAMED.format("nearest")).duckdb()


def _two_means_weights(window: int, step: int, columns: tuple[str, str] = ("x", "y")) -> Plan:
    """``weights`` (recording_id, i, x, y, status, w): Lloyd's rounds as a recursion over lists of points, started at the ends of the covariance's axis."""
    half = window // 2
    p = C.KIN.then("sized", f"SELECT recording_id, i, {columns[0]} AS x, {columns[1]} AS y, status, count(*) OVER (PARTITION BY recording_id) AS n FROM kin")
    p = p.then("windows", f"SELECT recording_id, c, greatest(0, c - {half}) AS a, least(n, c + {half + 1}) AS b FROM (SELECT recording_id, n, unnest(range({step}, n, {step})) AS c FROM (SELECT DISTINCT recording_id, n FROM sized) q) r")
    p = p.then("rates", "SELECT unnest([1, 2, 4]) AS rate")
    p = p.then("points", "SELECT w.recording_id, w.c, w.a, w.b, r.rate, list(s.x ORDER BY s.i) AS xs, list(s.y ORDER BY s.i) AS ys FROM windows w CROSS JOIN rates r JOIN sized s ON s.recording_id = w.recording_id AND s.i >= w.a AND s.i < w.b AND (s.i - w.a) % r.rate = 0 GROUP BY w.recording_id, w.c, w.a, w.b, r.rate HAVING count(*) >= 3 AND max(s.x) - min(s.x) + max(s.y) - min(s.y) > 0")
    p = p.then("moments", "SELECT *, list_avg(xs) AS mx, list_avg(ys) AS my, list_sum(list_transform(xs, lambda z: power(z - list_avg(xs), 2))) - list_sum(list_transform(ys, lambda z: power(z - list_avg(ys), 2))) AS dd, 2 * list_sum(list_transform(range(1, len(xs) + 1), lambda k: (xs[k] - list_avg(xs)) * (ys[k] - list_avg(ys)))) AS xy FROM points")
    p = p.then("along", "SELECT *, list_transform(range(1, len(xs) + 1), lambda k: (xs[k] - mx) * cos(atan2(xy, dd) / 2) + (ys[k] - my) * sin(atan2(xy, dd) / 2)) AS z FROM moments")
    p = p.then("starts", "SELECT *, list_position(z, list_min(z)) AS lo, list_position(z, list_max(z)) AS hi FROM along")
    mean = lambda c, g: f"CASE WHEN list_contains(new, {g}) THEN list_sum(list_transform(range(1, len(xs) + 1), lambda k: CASE WHEN new[k] = {g} THEN {c}s[k] ELSE 0 END)) / len(list_filter(new, lambda z: z = {g})) ELSE {c}{g} END"
    p = p.then(
        "lloyd",
        f"""SELECT recording_id, c, a, b, rate, xs, ys, xs[lo] AS x0, ys[lo] AS y0, xs[hi] AS x1, ys[hi] AS y1, list_transform(xs, lambda z: 0) AS label, 0 AS round, false AS done FROM starts
        UNION ALL SELECT recording_id, c, a, b, rate, xs, ys, {mean('x', 0)}, {mean('y', 0)}, {mean('x', 1)}, {mean('y', 1)}, new, round + 1, new = label
        FROM (SELECT *, list_transform(range(1, len(xs) + 1), lambda k: CASE WHEN power(xs[k] - x0, 2) + power(ys[k] - y0, 2) <= power(xs[k] - x1, 2) + power(ys[k] - y1, 2) THEN 0 ELSE 1 END) AS new FROM lloyd WHERE NOT done AND round < 20) q""",
    )
    p = p.then("turns", "SELECT recording_id, b, a, rate, list_filter(range(2, len(label) + 1), lambda k: label[k] <> label[k - 1]) AS ks FROM lloyd WHERE done OR round = 20")
    p = p.then("changes", "SELECT recording_id, b, rate, 1e0 / len(ks) AS w, a + (unnest(ks) - 1) * rate AS pos FROM turns")
    p = p.then("votes", "SELECT recording_id, unnest(range(pos, least(pos + rate, b))) AS i, w FROM changes")
    p = p.then("seen", "SELECT recording_id, i, count(*) AS n FROM (SELECT recording_id, unnest(range(a, b)) AS i FROM windows) q GROUP BY recording_id, i")
    p = p.then("summed", "SELECT recording_id, i, sum(w) AS w FROM votes GROUP BY recording_id, i")
    return p.then("weights", "SELECT s.recording_id, s.i, s.x, s.y, s.status, CASE WHEN e.n > 0 THEN coalesce(v.w, 0) / e.n END AS w FROM sized s LEFT JOIN seen e ON e.recording_id = s.recording_id AND e.i = s.i LEFT JOIN summed v ON v.recording_id = s.recording_id AND v.i = s.i")


def two_means(limits: dict, window: int, step: int, shortest: int, distance: float) -> str:
    """I-2MC: light samples in runs, near runs joined."""
    p = _two_means_weights(window, step)
    p = p.then("light", "SELECT *, coalesce(w < avg(w) OVER (PARTITION BY recording_id) + stddev_pop(w) OVER (PARTITION BY recording_id), false) AS fix FROM weights")
    p = p.then("runs", f"SELECT recording_id, min(i) AS a, max(i) AS b FROM (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS g FROM light WHERE fix) q GROUP BY recording_id, g HAVING max(i) - min(i) >= {shortest}")
    p = p.then("next", "SELECT *, lead(a) OVER (PARTITION BY recording_id ORDER BY a) AS c FROM runs")
    p = p.then("held", f"SELECT recording_id, a, b FROM runs UNION ALL SELECT n.recording_id, n.b + 1, n.c - 1 FROM next n JOIN light s ON s.recording_id = n.recording_id AND s.i = n.b JOIN light t ON t.recording_id = n.recording_id AND t.i = n.c WHERE sqrt(power(t.x - s.x, 2) + power(t.y - s.y, 2)) < {distance}")
    p = p.then("raw", "SELECT k.recording_id, k.i, k.status, CASE WHEN h.a IS NULL THEN 0 ELSE 1 END AS scan FROM kin k LEFT JOIN held h ON h.recording_id = k.recording_id AND k.i BETWEEN h.a AND h.b")
    return recursive(two_classes(p, limits))


def two_means_feature(window: int, step: int) -> str:
    """The I-FC feature of that name, on visual angles."""
    return recursive(_two_means_weights(window, step, ("theta_x", "theta_y")).then("out", f"SELECT recording_id, i, {FOUR.format('coalesce(w, 0)')} AS i2mc FROM weights"))


def entropies(p: Plan, squarings: int = 14) -> str:
    """Entropies after ``tr`` (recording_id, src, dst, n), a row an area: the stationary shares by squaring the matrix."""
    p = p.then("names", "SELECT recording_id, src AS aoi FROM tr UNION SELECT recording_id, dst FROM tr")
    p = p.then("m0", "SELECT a.recording_id, a.aoi AS r, b.aoi AS c, CASE WHEN sum(t.n) OVER (PARTITION BY a.recording_id, a.aoi) > 0 THEN coalesce(t.n, 0) / CAST(sum(t.n) OVER (PARTITION BY a.recording_id, a.aoi) AS DOUBLE) ELSE 1e0 / count(*) OVER (PARTITION BY a.recording_id, a.aoi) END AS v FROM names a JOIN names b ON a.recording_id = b.recording_id LEFT JOIN tr t ON t.recording_id = a.recording_id AND t.src = a.aoi AND t.dst = b.aoi")
    for n in range(squarings):
        p = p.then(f"m{n + 1}", f"SELECT a.recording_id, a.r, b.c, sum(a.v * b.v) AS v FROM m{n} a JOIN m{n} b ON a.recording_id = b.recording_id AND a.c = b.r GROUP BY a.recording_id, a.r, b.c")
    p = p.then("shares", f"SELECT recording_id, c AS aoi, avg(v) AS pi FROM m{squarings} GROUP BY recording_id, c")
    log = "CASE WHEN {0} > 0 THEN ln({0}) ELSE 0 END"
    p = p.then("cells", f"SELECT m.recording_id, m.r AS aoi, s.pi, m.v * ({log.format('m.v')}) AS h, s.pi * m.v * ({log.format('(s.pi * m.v)')}) AS j, s.pi * m.v * (({log.format('m.v')}) - ({log.format('e.pi')})) AS i FROM m0 m JOIN shares s ON s.recording_id = m.recording_id AND s.aoi = m.r JOIN shares e ON e.recording_id = m.recording_id AND e.aoi = m.c")
    p = p.then("by_row", f"SELECT recording_id, aoi, any_value(pi) AS pi, -any_value(pi) * ({log.format('any_value(pi)')}) AS s, -sum(h) AS h, -sum(j) AS j, sum(i) AS i FROM cells GROUP BY recording_id, aoi")
    whole = {"stationary": "s", "joint": "j", "conditional": "pi * h", "mutual_information": "i"}
    wanted = ", ".join(f"{FOUR.format(f'sum({x}) OVER (PARTITION BY recording_id)')} AS {name}" for name, x in whole.items())
    return p.then("out", f"SELECT recording_id, aoi, {FOUR.format('h')} AS conditional_of_area, {FOUR.format('i')} AS mutual_information_of_area, {wanted} FROM by_row").duckdb()


def outline(width: float, height: float, k_max: int = 10, order: int = 4) -> str:
    """Hulls from the pairs of points that have all others on one side; the fractal dimension on a Hilbert curve built from its quarters."""
    p = C.PATH.then("spots", "SELECT DISTINCT recording_id, x, y FROM path")
    p = p.then("sides", "SELECT p.recording_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS turn, (q.x - p.x) * (r.x - p.x) + (q.y - p.y) * (r.y - p.y) AS along, power(q.x - p.x, 2) + power(q.y - p.y, 2) AS d FROM spots p JOIN spots q ON p.recording_id = q.recording_id AND (p.x <> q.x OR p.y <> q.y) JOIN spots r ON r.recording_id = p.recording_id")
    p = p.then("edges", "SELECT recording_id, px, py, qx, qy FROM sides GROUP BY recording_id, px, py, qx, qy HAVING bool_and(turn > 0 OR turn = 0 AND along >= 0 AND along <= d)")
    p = p.then("hulls", "SELECT recording_id, sum(px * qy - qx * py) / 2 AS area, count(*) AS vertices FROM edges GROUP BY recording_id")
    p = p.then("h0", "SELECT 0 AS d, 0 AS x, 0 AS y")
    for n in range(order):
        s = 2**n
        p = p.then(f"h{n + 1}", f"SELECT d, y AS x, x AS y FROM h{n} UNION ALL SELECT d + {s * s}, x, y + {s} FROM h{n} UNION ALL SELECT d + {2 * s * s}, x + {s}, y + {s} FROM h{n} UNION ALL SELECT d + {3 * s * s}, {2 * s - 1} - y, {s - 1} - x FROM h{n}")
    cell = lambda c, top: f"least({2**order - 1}, greatest(0, CAST(floor({c} / {top} * {2**order}) AS INTEGER)))"
    p = p.then("curve", f"SELECT recording_id, k, d, count(*) OVER (PARTITION BY recording_id) AS n FROM (SELECT recording_id, k, {cell('x', width)} AS gx, {cell('y', height)} AS gy FROM path) q JOIN h{order} h ON h.x = gx AND h.y = gy")
    p = p.then("reaches", f"SELECT unnest(range(1, {k_max + 1})) AS j")
    p = p.then("lengths", "SELECT a.recording_id, j, a.n, a.k % j AS m, sum(abs(b.d - a.d)) * (a.n - 1) / CAST((a.n - 1 - a.k % j) // j * j AS DOUBLE) AS l FROM curve a JOIN reaches ON j <= a.n // 2 JOIN curve b ON b.recording_id = a.recording_id AND b.k = a.k + j GROUP BY a.recording_id, j, a.n, a.k % j")
    p = p.then("mean_lengths", "SELECT recording_id, j, avg(l) AS l FROM lengths GROUP BY recording_id, j HAVING avg(l) > 0")
    p = p.then("slopes", "SELECT recording_id, regr_slope(ln(l), ln(1e0 / j)) AS h FROM mean_lengths GROUP BY recording_id HAVING count(*) > 1")
    return p.then("out", f"SELECT u.recording_id, {FOUR.format('u.area')} AS hull_area, CAST(u.vertices AS BIGINT) AS hull_vertices, {FOUR.format('s.h')} AS higuchi FROM hulls u LEFT JOIN slopes s ON s.recording_id = u.recording_id").duckdb()


def edit_measures(p: Plan, centers: dict[str, tuple[float, float]], bonus: float = 0.1, gap: float = 0.25, change: float = 0.3, base: float = 0.1, step: float = 0.05, near: float = 0.2) -> str:
    """Measures of symbol sequences ``syms`` (recording_id, k, aoi) row by row of all pairs' tables at once: what comes from the left is a running extreme.

    A recursion with a key keeps the last row of each pair only.
    """
    p = p.then("centers", " UNION ALL ".join(f"SELECT '{a}' AS aoi, {x!r} AS x, {y!r} AS y" for a, (x, y) in centers.items()))
    p = p.then("top", "SELECT max(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM centers a CROSS JOIN centers b")
    p = p.then("far", "SELECT a.aoi AS a, b.aoi AS b, a.aoi = b.aoi AS same, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / top.d AS d FROM centers a CROSS JOIN centers b CROSS JOIN top")
    p = p.then("placed", "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY k) AS j, aoi FROM syms")
    p = p.then("lens", "SELECT recording_id, count(*) AS n FROM placed GROUP BY recording_id")
    in_row = "OVER (PARTITION BY id_1, id_2 ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
    here, before, w = in_row.format("CURRENT ROW"), in_row.format("1 PRECEDING"), "OVER (PARTITION BY t.id_1, t.id_2 ORDER BY t.j)"
    p = p.then("tables", f"""SELECT a.recording_id AS id_1, b.recording_id AS id_2, unnest(range(0, b.n + 1)) AS j, CAST(0 AS BIGINT) AS i, a.n AS n, unnest(range(0, b.n + 1)) * 1e0 AS lev, unnest(range(0, b.n + 1)) * 1e0 * {change} AS gen, unnest(range(0, b.n + 1)) * -1e0 * {gap} AS nw, CAST(0 AS BIGINT) AS lcs, 0e0 AS h, -1e300 AS o, 0e0 AS best FROM lens a JOIN lens b ON a.recording_id < b.recording_id
        UNION ALL SELECT id_1, id_2, j, i, n, min(lev - j) {here} + j, min(gen - j * {change}) {here} + j * {change}, max(nw + j * {gap}) {here} - j * {gap}, max(lcs) {here},
          greatest(h, coalesce(max(h + {step} * j) {before} - {base} - {step} * j, 0)) AS h, o, greatest(best, h, coalesce(max(h + {step} * j) {before} - {base} - {step} * j, 0))
        FROM (SELECT id_1, id_2, j, i, n, CASE WHEN j = 0 THEN lev + 1 ELSE least(lev_d + CASE WHEN same THEN 0 ELSE 1 END, lev + 1) END AS lev, CASE WHEN j = 0 THEN gen + {change} ELSE least(gen_d + d, gen + {change}) END AS gen,
            CASE WHEN j = 0 THEN nw - {gap} ELSE greatest(nw_d + CASE WHEN same THEN {bonus} ELSE -d END, nw - {gap}) END AS nw, CASE WHEN j = 0 THEN 0 ELSE greatest(lcs, lcs_d + CASE WHEN same THEN 1 ELSE 0 END) END AS lcs,
            CASE WHEN j = 0 THEN 0 ELSE greatest(0, h_d + {near} - d, greatest(o, h - {base}) - {step}) END AS h, greatest(o, h - {base}) - {step} AS o, best
          FROM (SELECT t.id_1, t.id_2, t.j, t.i + 1 AS i, t.n, t.lev, t.gen, t.nw, t.lcs, t.h, t.o, t.best, f.same, f.d, lag(lev) {w} AS lev_d, lag(gen) {w} AS gen_d, lag(nw) {w} AS nw_d, lag(lcs) {w} AS lcs_d, lag(h) {w} AS h_d
            FROM tables t JOIN placed a ON a.recording_id = t.id_1 AND a.j = t.i + 1 LEFT JOIN placed b ON b.recording_id = t.id_2 AND b.j = t.j LEFT JOIN far f ON f.a = a.aoi AND f.b = b.aoi) q) r""")
    p = p.then("ends", "SELECT id_1, id_2, greatest(any_value(n), max(j)) AS longer, arg_max(lev, j) AS lev, arg_max(gen, j) AS gen, arg_max(nw, j) AS nw, arg_max(lcs, j) AS lcs, max(best) AS best FROM tables WHERE i = n GROUP BY id_1, id_2")
    wanted = {"levenshtein": "lev / longer", "generalized_edit": "gen / longer", "needleman_wunsch": "-nw / longer", "longest_common_subsequence": "lcs / longer", "smith_waterman": f"best / (longer * {near} * top.d)"}
    p = p.then("out", " UNION ALL ".join(f"SELECT id_1, id_2, '{m}' AS metric, floor({x} * 1e6 + 0.5001) / 1e6 AS value FROM ends CROSS JOIN top" for m, x in wanted.items()))
    return recursive(p).replace("tables AS (", "tables USING KEY (id_1, id_2, j) AS (", 1)
