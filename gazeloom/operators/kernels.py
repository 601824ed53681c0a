"""Numeric kernels on one recording or one pair: sequential scans, dynamic programs, spectra, shapes, clusters.

Plain numpy functions; ``grouped.py`` runs them inside Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# ---------------------------------------------------------------- segmentation


def mark_intervals(n: int, intervals: list[tuple[int, int]]) -> np.ndarray:
    """1 on samples inside an interval [a, b]."""
    out = np.zeros(n, int)
    for a, b in intervals:
        out[a : b + 1] = 1
    return out


def _spread(x: np.ndarray, y: np.ndarray) -> float:
    """Dispersion, summed from the left as in SQL: extents that meet a limit exactly are rounded alike."""
    return float(x.max() - x.min() + y.max() - y.min())


def dispersion_windows(x: np.ndarray, y: np.ndarray, window: int, limit: float) -> np.ndarray:
    """I-DiT: windows that grow while their dispersion is below the limit; 1 on fixation samples.

    The sample that broke the limit ends the fixation and the next window starts after it. A window never grows onto the last sample; at the end windows may be shorter, of two samples at least.
    """
    n, start = len(x), 0
    fix = np.zeros(n, int)
    while start + 2 <= min(start + window, n):
        stop = min(start + window, n)
        box = [x[start:stop].min(), x[start:stop].max(), y[start:stop].min(), y[start:stop].max()]
        if box[1] - box[0] + box[3] - box[2] >= limit:
            start += 1
            continue
        while stop < n - 1 and box[1] - box[0] + box[3] - box[2] < limit:
            box = [min(box[0], x[stop]), max(box[1], x[stop]), min(box[2], y[stop]), max(box[3], y[stop])]
            stop += 1
        fix[start:stop] = 1
        start = stop
    return fix


def density_runs(x: np.ndarray, y: np.ndarray, eps: float, window: int, min_points: int) -> np.ndarray:
    """I-DeT: temporal density clusters; a sample's neighbourhood grows outward in time to the first sample farther than ``eps``. 1 on members of a cluster."""
    n = len(x)

    def near(i: int) -> range:
        lo = i
        while lo > 0 and i - lo < window and math.hypot(x[lo - 1] - x[i], y[lo - 1] - y[i]) <= eps:
            lo -= 1
        hi = i
        while hi < n - 1 and hi - i < window and math.hypot(x[hi + 1] - x[i], y[hi + 1] - y[i]) <= eps:
            hi += 1
        return range(lo, hi + 1)

    fix = np.zeros(n, int)
    for i in range(n):
        around = near(i)
        if len(around) >= min_points:
            fix[around.start : around.stop] = 1
    return fix


def gaussian_hmm_1d(v: np.ndarray, low: float, high: float, variance: float, rounds: int = 10) -> np.ndarray:
    """I-HMM: two-state Gaussian model of speed by scaled Baum-Welch, decoded by Viterbi; 1 where the state with the smaller mean."""
    if not len(v):
        return np.zeros(0, int)
    mean, var = np.array([low, high]), np.array([variance, variance])
    start, trans = np.full(2, 0.5), np.full((2, 2), 0.5)
    density = lambda: np.exp(-0.5 * (v[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var) + 1e-300
    n = len(v)
    for _ in range(rounds):
        b = density()
        alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.zeros(n)
        for t in range(n):
            a = start * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        xi = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, b[1:] * beta[1:] / scale[1:, None]) if n > 1 else trans
        start, trans = gamma[0], xi / np.maximum(xi.sum(1, keepdims=True), 1e-12)
        mean = (gamma * v[:, None]).sum(0) / np.maximum(gamma.sum(0), 1e-12)
        var = np.maximum((gamma * (v[:, None] - mean) ** 2).sum(0) / np.maximum(gamma.sum(0), 1e-12), 1e-6)
    states = viterbi(np.log(start + 1e-9), np.log(trans + 1e-9), np.log(density() + 1e-9))
    slow = states == int(np.argmin(mean))
    fix = slow.astype(int)
    fix[1:] |= slow[:-1]
    return fix


def viterbi(start: np.ndarray, trans: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """Likeliest states from log probabilities."""
    n, k = emission.shape
    score, back = start + emission[0], np.zeros((n, k), int)
    for t in range(1, n):
        step = score[:, None] + trans
        back[t] = step.argmax(0)
        score = step.max(0) + emission[t]
    out = np.zeros(n, int)
    out[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def kalman_gains(n: int, dt: float, sigma_1: float, sigma_2: float) -> np.ndarray:
    """Gains of position and speed at each sample after the first; they hang on the parameters only.

    The covariance starts at zero, and its update multiplies entry by entry, as users of the method know it.
    """
    p = [0.0, 0.0, 0.0, 0.0]
    out = np.zeros((n, 2))
    for t in range(1, n):
        q = (p[0] + dt * (p[1] + p[2]) + dt * dt * p[3] + sigma_1**2, p[1] + dt * p[3], p[2] + dt * p[3], p[3] + sigma_1**2)
        gain = q[0] / (q[0] + sigma_2**2), q[2] / (q[0] + sigma_2**2)
        p = [(1 - gain[0]) * q[0], q[1], (1 - gain[1]) * q[2], q[3]]
        out[t] = gain
    return out


def kalman_speed(pos: np.ndarray, first_speed: float, gains: np.ndarray, dt: float) -> np.ndarray:
    """Predicted speeds of a constant-velocity Kalman filter on the positions of an axis; the first is given."""
    where, speed = float(pos[0]), float(first_speed)
    out = np.full(len(pos), speed)
    for t, (seen, (g, h)) in enumerate(zip(pos[1:].tolist(), gains[1:].tolist(), strict=False), 1):
        out[t] = speed
        off = seen - (where + dt * speed)
        where, speed = where + dt * speed + g * off, speed + h * off
    return out


def kalman_windows(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, dt: float, sigma_1: float, sigma_2: float, window: int, limit: float, divisor: float = 5.0) -> np.ndarray:
    """I-KF: windows whose summed squared difference of predicted and measured speed, over ``divisor``, is at most the limit are fixation, and so is the sample after each; what follows the last whole window counts as 0. The last sample is never marked by itself."""
    n = len(x)
    if not n:
        return np.zeros(0, int)
    gains = kalman_gains(n, dt, sigma_1, sigma_2)
    off = (np.hypot(kalman_speed(x, vx[0], gains, dt), kalman_speed(y, vy[0], gains, dt)) - np.hypot(vx, vy)) ** 2
    # a window that ends with the recording is a partial one
    whole = max(0, (n - 1) // window)
    chi = np.zeros(n)
    chi[: whole * window] = np.repeat(off[: whole * window].reshape(whole, window).sum(1) / divisor, window)
    low = chi[:-1] <= limit
    fix = np.zeros(n, bool)
    fix[:-1] |= low
    fix[1:] |= low
    return fix.astype(int)


def spanning_tree_votes(x: np.ndarray, y: np.ndarray, window: int, eps: float, min_points: int) -> np.ndarray:
    """I-MST: in half-overlapping windows, components of the minimum spanning tree without edges of ``eps`` or more vote; fixation by at least half of the votes."""
    n, step = len(x), max(1, window // 2)
    votes, seen = np.zeros(n), np.zeros(n)
    for a in range(0, max(1, n - window + 1), step):
        b = min(n, a + window)
        d = np.hypot(x[a:b, None] - x[a:b], y[a:b, None] - y[a:b])
        parent = list(range(b - a))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(d < eps, 1)), strict=True):
            parent[find(int(i))] = find(int(j))
        roots = np.array([find(i) for i in range(b - a)])
        size = np.bincount(roots, minlength=b - a)[roots]
        votes[a:b] += size >= min_points
        seen[a:b] += 1
    return ((seen > 0) & (votes >= 0.5 * seen)).astype(int)


def two_means(points: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Labels of a deterministic 2-means: started at the two points farthest along the main axis."""
    centred = points - points.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    along = centred @ axis
    centres = points[[int(along.argmin()), int(along.argmax())]].astype(float)
    label = np.zeros(len(points), int)
    for _ in range(rounds):
        new = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        for k in (0, 1):
            if (new == k).any():
                centres[k] = points[new == k].mean(0)
        if (new == label).all():
            break
        label = new
    return label


def two_means_of(points: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The same for many sets of equal size (sets, points, 2) at once; sums run in the order of the points."""
    n, m = points.shape[:2]
    total = points[:, 0].copy()
    for j in range(1, m):
        total += points[:, j]
    centred = points - (total / m)[:, None]
    axis = np.linalg.svd(centred, full_matrices=False)[2][:, 0]
    along = centred[:, :, 0] * axis[:, None, 0] + centred[:, :, 1] * axis[:, None, 1]
    at = np.arange(n)
    centres = np.stack([points[at, along.argmin(1)], points[at, along.argmax(1)]], 1)
    label = np.zeros((n, m), int)
    open_ = at
    for _ in range(rounds):
        p, c = points[open_], centres[open_]
        far = [(p[:, :, 0] - c[:, None, k, 0]) ** 2 + (p[:, :, 1] - c[:, None, k, 1]) ** 2 for k in (0, 1)]
        new = (far[1] < far[0]).astype(int)
        for k in (0, 1):
            mine = new == k
            count = mine.sum(1)
            sums = np.zeros((len(p), 2))
            for j in range(m):
                sums += np.where(mine[:, j, None], p[:, j], 0.0)
            c[:, k] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c[:, k])
        same = (new == label[open_]).all(1)
        label[open_], centres[open_] = new, c
        open_ = open_[~same]
        if not len(open_):
            break
    return label


def numbers(bounds: np.ndarray) -> np.ndarray:
    """Each sample's recording as a number, for recordings between ``bounds``."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _ends(n: int, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First and past sample of each sample's recording; all are one without ``bounds``."""
    bounds = np.array([0, n]) if bounds is None else bounds
    which = numbers(bounds)
    return bounds[:-1][which], bounds[1:][which]


def two_means_weights(x: np.ndarray, y: np.ndarray, window: int, step: int, bounds: np.ndarray | None = None) -> np.ndarray:
    """I-2MC: mean weight of label changes over windows of ``window`` samples around every ``step``-th sample, at full, half and quarter rate; cut at the ends, NaN where none covers.

    A window's changes share a weight of one; at lower rates a change counts for all samples that its one stands for.
    Recordings follow each other between ``bounds``; windows of one size are parted together.
    """
    n, half, step = len(x), window // 2, max(1, step)
    start, past = _ends(n, bounds)
    place = np.arange(n) - start
    centre = np.flatnonzero((place > 0) & (place % step == 0))
    a, b = np.maximum(start[centre], centre - half), np.minimum(past[centre], centre + half + 1)
    pts = np.stack([x, y], 1).astype(float)
    order, to, weight = [], [], []
    for turn, rate in enumerate((1, 2, 4)):
        size = -(-(b - a) // rate)
        for m in np.unique(size[size >= 3]):
            for these in np.array_split(np.flatnonzero(size == m), max(1, (size == m).sum() * int(m) // 100_000)):
                at = a[these, None] + rate * np.arange(m)
                some = np.ptp(pts[at], axis=1).sum(1) != 0
                these, at = these[some], at[some]
                if not len(these):
                    continue
                row, column = np.nonzero(np.diff(two_means_of(pts[at]), axis=1))
                share = 1 / np.bincount(row, minlength=len(these)).clip(1)[row]
                first = at[row, column + 1]
                for j in range(rate):
                    inside = first + j < b[these[row]]
                    order.append((these[row] * 3 + turn)[inside])
                    to.append((first + j)[inside])
                    weight.append(share[inside])
    total = np.zeros(n)
    if order:
        by = np.argsort(np.concatenate(order), kind="stable")
        total = np.bincount(np.concatenate(to)[by], np.concatenate(weight)[by], n)
    seen = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n]
    return np.divide(total, seen, out=np.full(n, np.nan), where=seen > 0)


def merged_runs(fix: np.ndarray, x: np.ndarray, y: np.ndarray, shortest: int, distance: float) -> np.ndarray:
    """Runs of fixation longer than ``shortest`` samples; the samples between two of them are fixation, too, where the second starts nearer than ``distance`` to the first one's end."""
    step = np.diff(np.concatenate([[0], fix, [0]]))
    runs = [(a, b) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1, strict=True) if b - a >= shortest]
    between = [(b + 1, c - 1) for (_, b), (c, _) in zip(runs, runs[1:], strict=False) if math.hypot(x[c] - x[b], y[c] - y[b]) < distance]
    return mark_intervals(len(fix), runs + between)


def two_means_fixations(x: np.ndarray, y: np.ndarray, window: int, step: int, shortest: int = 0, distance: float = 0.0, bounds: np.ndarray | None = None) -> np.ndarray:
    """Fixation where the weight is below its mean plus one deviation; near fixations become one. Recordings follow each other between ``bounds``."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    bounds = np.array([0, len(x)]) if bounds is None else bounds
    weights, out = two_means_weights(x, y, window, step, bounds), np.zeros(len(x), int)
    for a, b in zip(bounds, bounds[1:], strict=False):
        w = weights[a:b]
        if np.isfinite(w).any():
            fix = np.nan_to_num(w < np.nanmean(w) + np.nanstd(w), nan=0).astype(int)
            out[a:b] = merged_runs(fix, x[a:b], y[a:b], shortest, distance)
    return out


def velocity_dispersion(x: np.ndarray, y: np.ndarray, speed: np.ndarray, fast: float, window: int, limit: float) -> np.ndarray:
    """I-VDT: 2 above the speed limit; in slow runs longer than a window 1 in growing windows of small dispersion, 0 on the sample that ends one, 3 elsewhere."""
    slow = np.concatenate([[0], (speed <= fast).astype(int), [0]])
    label = np.where(speed > fast, 2, 3)
    edges = np.diff(slow)
    for first, past in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        start = first if past - first > window else past
        while start + window <= past:
            stop = start + window
            if _spread(x[start:stop], y[start:stop]) >= limit:
                start += 1
                continue
            while stop < past and _spread(x[start:stop], y[start:stop]) < limit:
                stop += 1
            label[start : stop - 1], label[stop - 1] = 1, 0
            start = stop
    return label


# ---------------------------------------------------------------- dynamic programs


def _table(top: np.ndarray, side: np.ndarray, cost: np.ndarray, step: Callable[..., np.ndarray]) -> np.ndarray:
    """A dynamic program's table by anti-diagonals: ``step(diagonal, above, left, cost)`` gives all cells of one at once."""
    n, m = cost.shape
    table = np.empty((n + 1, m + 1))
    table[0], table[:, 0] = top, side
    if n and m:
        flat, wide = table.ravel(), np.zeros((n, m + 1))
        wide[:, :m] = cost
        c = wide.ravel()
        for d in range(n + m - 1):
            lo, hi = max(0, d - m + 1), min(n - 1, d)
            a, b = (lo + 1) * m + d + 2, (hi + 1) * m + d + 3
            flat[a:b:m] = step(flat[a - m - 2 : b - m - 2 : m], flat[a - m - 1 : b - m - 1 : m], flat[a - 1 : b - 1 : m], c[lo * m + d : hi * m + d + 1 : m])
    return table


def _costs(a: list, b: list, cost: Callable[[int, int], float] | np.ndarray | None) -> np.ndarray:
    """Cost of each pair of places, given as a table or by place; without ``cost`` 0 for equal symbols and 1 else."""
    if isinstance(cost, np.ndarray):
        return cost
    if cost is None:
        number: dict = {}
        x, y = (np.array([number.setdefault(v, len(number)) for v in s], int) for s in (a, b))
        return (x[:, None] != y).astype(float)
    return np.array([[cost(i, j) for j in range(len(b))] for i in range(len(a))], float).reshape(len(a), len(b))


def _edit_table(a: list, b: list, deletion: float, insertion: float, cost: np.ndarray) -> np.ndarray:
    top, side = np.arange(len(b) + 1) * insertion, np.arange(len(a) + 1) * deletion
    return _table(top, side, cost, lambda d, up, left, c: np.minimum(np.minimum(d + c, up + deletion), left + insertion))


def weighted_levenshtein(a: list, b: list, deletion: float = 1.0, insertion: float = 1.0, substitution=None) -> float:
    """Edit distance with given costs; ``substitution(i, j)`` defaults to 0 for equal symbols and 1 else."""
    return float(_edit_table(a, b, deletion, insertion, _costs(a, b, substitution))[-1, -1])


def edit_alignment(a: list, b: list, deletion: float = 1.0, insertion: float = 1.0, substitution=None) -> tuple[float, list[tuple[int, int]]]:
    """Edit distance and its alignment: places (i, j) from the start, -1 for a gap. Of equal ways back a pair comes before a deletion and that before an insertion."""
    cost = _costs(a, b, substitution)
    table = _edit_table(a, b, deletion, insertion, cost)
    out, i, j = [], len(a), len(b)
    while i or j:
        here = table[i, j]
        if i and j and table[i - 1, j - 1] + cost[i - 1, j - 1] == here:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and (not j or table[i - 1, j] + deletion == here):
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return float(table[-1, -1]), out[::-1]


def needleman_wunsch(a: list, b: list, bonus: float = 0.1, gap: float = 0.25, mismatch=None) -> float:
    """Best global alignment score: ``bonus`` for equal symbols, minus a distance for others, minus ``gap``."""
    same = _costs(a, b, None) == 0
    fit = np.where(same, bonus, -_costs(a, b, (lambda i, j: 1.0) if mismatch is None else mismatch))
    return float(_table(-np.arange(len(b) + 1) * gap, -np.arange(len(a) + 1) * gap, fit, lambda d, up, left, c: np.maximum(np.maximum(d + c, up - gap), left - gap))[-1, -1])


def _distances(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    # a tenth of the time of hypot
    return np.sqrt((s[:, None, 0] - t[None, :, 0]) ** 2 + (s[:, None, 1] - t[None, :, 1]) ** 2)


def _warp_table(s: np.ndarray, t: np.ndarray, join: Callable[[np.ndarray, np.ndarray], np.ndarray], first: float) -> np.ndarray:
    top, side = np.full(len(t) + 1, np.inf), np.full(len(s) + 1, np.inf)
    top[0] = side[0] = first
    return _table(top, side, _distances(s, t), lambda d, up, left, c: join(c, np.minimum(np.minimum(d, up), left)))


#: How a warping joins a distance to the best way so far, and what it starts from.
WARPS = {"dtw": (np.add, 0.0), "frechet": (np.maximum, -np.inf)}


def dtw(s: np.ndarray, t: np.ndarray) -> float:
    """Dynamic time warping distance of two point sequences."""
    return float(_warp_table(s, t, *WARPS["dtw"])[-1, -1])


def discrete_frechet(s: np.ndarray, t: np.ndarray) -> float:
    """Discrete Frechet distance."""
    return float(_warp_table(s, t, *WARPS["frechet"])[-1, -1])


def warp_links(s: np.ndarray, t: np.ndarray, kind: str = "dtw") -> tuple[float, list[tuple[int, int]]]:
    """Distance and linked places (i, j) of a warping, from the start; of equal ways back the diagonal comes first, then the first sequence's step. Empty sequences have none."""
    table = _warp_table(s, t, *WARPS[kind])
    out, i, j = [], len(s), len(t)
    while i and j:
        out.append((i - 1, j - 1))
        back = (table[i - 1, j - 1], table[i - 1, j], table[i, j - 1])
        at = back.index(min(back))
        i, j = i - (at != 2), j - (at != 1)
    return float(table[-1, -1]), out[::-1]


def warp_within(s: np.ndarray, t: np.ndarray, limit: float, kind: str = "dtw") -> float:
    """The warping distance if it is at most ``limit``, else infinity; ends early, since each way meets one of two neighbouring diagonals."""
    join, first = WARPS[kind]
    d = _distances(s, t)
    n, m = d.shape
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    before[0] = first
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        now = np.full(n + 1, np.inf)
        now[i + 1] = join(d[i, k - i], np.minimum(np.minimum(before[i], last[i]), last[i + 1]))
        if min(now.min(), last.min()) > limit:
            return math.inf
        before, last = last, now
    return float(last[n]) if last[n] <= limit else math.inf


def longest_common_subsequence(a: list, b: list) -> list:
    """A longest common subsequence; of equal ones the one that skips the first sequence's end."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _local_table(fit: np.ndarray, base: float, step: float) -> np.ndarray:
    """Scores of the best local alignment that ends at each pair of places.

    A gap that follows a gap of the same direction is never better than one longer gap, so a row's gaps start from the cells without one.
    """
    n, m = fit.shape
    h, open_ = np.zeros((n + 1, m + 1)), np.full(m + 1, -np.inf)
    ramp = step * np.arange(m + 1)
    for i in range(1, n + 1):
        open_ = np.maximum(open_, h[i - 1] - base) - step
        row = np.maximum(0.0, open_)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + fit[i - 1])
        row[0] = 0.0
        row[1:] = np.maximum(row[1:], np.maximum.accumulate(row + ramp)[:-1] - base - ramp[1:])
        h[i] = row
    return h


def _similarities(a: list, b: list, similarity: Callable[[int, int], float] | np.ndarray | None) -> np.ndarray:
    return 1.0 - 2.0 * _costs(a, b, None) if similarity is None else _costs(a, b, similarity)


def smith_waterman(a: list, b: list, similarity=None, base: float = 0.1, step: float = 0.05) -> float:
    """Best local alignment score with gap costs base + step * length."""
    return float(_local_table(_similarities(a, b, similarity), base, step).max())


def local_alignment(a: list, b: list, similarity=None, base: float = 0.1, step: float = 0.05) -> tuple[float, list[tuple[int, int]]]:
    """Score and places (i, j) of a best local alignment, -1 for gaps; of equal ends the first, of equal ways back a pair, then a gap in ``b``, then one in ``a``."""
    fit = _similarities(a, b, similarity)
    h = _local_table(fit, base, step)
    i, j = (int(v) for v in np.unravel_index(h.argmax(), h.shape))
    out = []
    while h[i, j] > 0:
        if abs(h[i - 1, j - 1] + fit[i - 1, j - 1] - h[i, j]) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
            continue
        up = np.flatnonzero(np.abs(h[i - 1 :: -1, j] - base - step * np.arange(1, i + 1) - h[i, j]) < 1e-9)
        if len(up):
            gap = int(up[0]) + 1
            out += [(i - 1 - k, -1) for k in range(gap)]
            i -= gap
        else:
            gap = int(np.flatnonzero(np.abs(h[i, j - 1 :: -1] - base - step * np.arange(1, j + 1) - h[i, j]) < 1e-9)[0]) + 1
            out += [(-1, j - 1 - k) for k in range(gap)]
            j -= gap
    return float(h.max()), out[::-1]


def edit_distance(a: list, b: list) -> int:
    """Edit distance with unit costs of sequences of hashable symbols: a row of the table as the bits of two numbers, steps up and steps down."""
    if not a:
        return len(b)
    masks: dict = {}
    for i, s in enumerate(a):
        masks[s] = masks.get(s, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for s in b:
        hit = masks.get(s, 0)
        across = ((hit & up) + up ^ up) | hit
        more, less = down | full & ~(across | up), up & across
        score += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        hit |= down
        up, down = (less | ~(hit | more)) & full, more & hit & full
    return score


def emine(sequences: list[list]) -> list:
    """A common subsequence: the closest pair is replaced by its longest common subsequence until one is left; of equally close pairs the first, merged ones come last."""
    left = dict(enumerate(list(s) for s in sequences))
    far = {(i, j): edit_distance(left[i], left[j]) for i in left for j in left if i < j}
    while len(left) > 1:
        _, i, j = min((d, i, j) for (i, j), d in far.items())
        common, new = longest_common_subsequence(left.pop(i), left.pop(j)), max(i, j, *left, 0) + 1
        far = {k: d for k, d in far.items() if i not in k and j not in k} | {(k, new): edit_distance(s, common) for k, s in left.items()}
        left[new] = common
    return next(iter(left.values()), [])


def barycentre_votes(mean: list, s: list) -> list[tuple[int, object]]:
    """(place, symbol) for each link of the warping of a sequence onto a consensus; of equal ways back the diagonal comes first, then the consensus's step."""
    if not mean or not s:
        return []
    d = _costs(mean, s, None)
    top, side = np.full(len(s) + 1, np.inf), np.full(len(mean) + 1, np.inf)
    top[0] = side[0] = 0
    acc = _table(top, side, d, lambda diagonal, up, left, c: c + np.minimum(np.minimum(diagonal, up), left))
    i, j, out = len(mean), len(s), []
    while i and j:
        out.append((i - 1, s[j - 1]))
        _, i, j = min((acc[i - 1, j - 1], i - 1, j - 1), (acc[i - 1, j], i - 1, j), (acc[i, j - 1], i, j - 1))
    return out


def barycentre_step(votes: list[dict], pairs: set[tuple]) -> list:
    """The symbol with most votes for each place (the first in order at a tie) among those that follow the one before in some sequence."""
    new: list = []
    for v in votes:
        ranked = sorted(v, key=lambda x: (-v[x], str(x)))
        allowed = [x for x in ranked if not new or x == new[-1] or (new[-1], x) in pairs]
        new.append((allowed or ranked)[0])
    return new


def cdba(sequences: list[list], rounds: int = 20, seed: int = 1, start: list | None = None) -> list:
    """Constrained barycentre: a start (seeded, if none is given) of median length, improved by majority over alignments; neighbours must occur together in some sequence."""
    rng = np.random.default_rng(seed)
    sequences = [s for s in sequences if s]
    if not sequences:
        return []
    pairs = {p for s in sequences for p in zip(s, s[1:], strict=False)}
    start = sequences[int(rng.integers(len(sequences)))] if start is None else start
    mean = list(start[: int(np.median([len(s) for s in sequences]))])
    for _ in range(rounds):
        votes: list[dict] = [{} for _ in mean]
        for s in sequences:
            for place, symbol in barycentre_votes(mean, s):
                votes[place][symbol] = votes[place].get(symbol, 0) + 1
        new = barycentre_step(votes, pairs)
        if new == mean:
            break
        mean = new
    return mean


def lempel_ziv(symbols: list) -> list[tuple]:
    """LZ78 phrases; their number is the complexity."""
    seen, out, phrase = set(), [], ()
    for s in symbols:
        phrase += (s,)
        if phrase not in seen:
            seen.add(phrase)
            out.append(phrase)
            phrase = ()
    return out + ([phrase] if phrase else [])


# ---------------------------------------------------------------- MultiMatch, ScanMatch, Mannan


def _without(p: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Points that stay, each with the durations of those that go right behind it; the first stays."""
    out = p[~gone].copy()
    out[:, 2] = np.bincount(np.cumsum(~gone) - 1, p[:, 2])
    return out


def simplify_scanpath(p: np.ndarray, amplitude: float, angle: float, duration: float, rounds: int = 10) -> np.ndarray:
    """Saccades (x, y of start, dx, dy, duration) of a simplified scanpath.

    Each round first drops short fixations where the direction hardly turns, then those at the end of a small saccade that starts or ends at a short fixation; ends when nothing goes.
    """
    p = np.asarray(p, float)[:, :3]
    for _ in range(rounds):
        before = len(p)
        if len(p) > 2:
            d = np.diff(p[:, :2], axis=0)
            size = np.hypot(d[:, 0], d[:, 1])
            both = size[:-1] * size[1:]
            cos = np.divide((d[:-1] * d[1:]).sum(1), both, out=np.ones_like(both), where=both > 0)
            turn = np.degrees(np.arccos(np.clip(cos, -1, 1)))
            p = _without(p, np.concatenate([[False], (turn <= angle) & (p[1:-1, 2] <= duration), [False]]))
        if len(p) > 1:
            step = np.hypot(*np.diff(p[:, :2], axis=0).T)
            p = _without(p, np.concatenate([[False], (step <= amplitude) & ((p[:-1, 2] <= duration) | (p[1:, 2] <= duration))]))
        if len(p) == before:
            break
    return np.concatenate([p[:-1, :2], np.diff(p[:, :2], axis=0), p[:-1, 2:]], 1)


def simplification(diagonal: float, amplitude: float = 0.055, angle: float = 35.0, duration: float = 0.4) -> tuple[float, float, float]:
    """Limits of :func:`simplify_scanpath` as MultiMatch has them, the amplitude a share of the plane's diagonal."""
    return amplitude * diagonal, angle, duration


#: Columns and rows of cells of ScanMatch.
SCANMATCH = (20, 20)


def multimatch(p: np.ndarray, q: np.ndarray, diagonal: float, amplitude: float = 0.055, angle: float = 35.0, duration: float = 0.4) -> dict[str, float]:
    """Five similarities (shape, length, angle, position, duration) over the cheapest monotone alignment of simplified saccades."""
    s, t = (simplify_scanpath(z, *simplification(diagonal, amplitude, angle, duration)) for z in (p, q))
    names = ("shape", "length", "angle", "position", "duration")
    if not len(s) or not len(t):
        return dict.fromkeys(names, float("nan"))
    d = np.hypot(s[:, None, 2] - t[None, :, 2], s[:, None, 3] - t[None, :, 3])
    top, side = np.full(len(t) + 1, np.inf), np.full(len(s) + 1, np.inf)
    top[0] = side[0] = 0
    acc = _table(top, side, d, lambda diagonal, up, left, c: c + np.minimum(np.minimum(diagonal, up), left))
    i, j, path = len(s), len(t), []
    while i and j:
        path.append((i - 1, j - 1))
        _, i, j = min((acc[i - 1, j - 1], i - 1, j - 1), (acc[i - 1, j], i - 1, j), (acc[i, j - 1], i, j - 1))
    u, v = s[[a for a, _ in path]], t[[b for _, b in path]]
    lu, lv = np.hypot(u[:, 2], u[:, 3]), np.hypot(v[:, 2], v[:, 3])
    turn = np.abs(np.arctan2(u[:, 3], u[:, 2]) - np.arctan2(v[:, 3], v[:, 2]))
    turn = np.minimum(turn, 2 * math.pi - turn)
    diffs = (np.hypot(u[:, 2] - v[:, 2], u[:, 3] - v[:, 3]) / (2 * diagonal), np.abs(lu - lv) / diagonal, turn / math.pi, np.hypot(u[:, 0] - v[:, 0], u[:, 1] - v[:, 1]) / diagonal, np.abs(u[:, 4] - v[:, 4]) / np.maximum(np.maximum(u[:, 4], v[:, 4]), 1e-12))
    return {k: float(np.clip(1 - x.mean(), 0, 1)) for k, x in zip(names, diffs, strict=True)}


def scanmatch_cells(z: np.ndarray, width: float, height: float, nx: int, ny: int, step: float) -> list[tuple[int, int]]:
    """Cells of a scanpath, each repeated for every started ``step`` seconds."""
    c = [(int(min(x, width - 1e-3) / (width / nx)), int(min(y, height - 1e-3) / (height / ny))) for x, y, _ in z]
    return [k for k, d in zip(c, z[:, 2], strict=True) for _ in range(max(1, math.ceil(d / step)))]


def scanmatch(p: np.ndarray, q: np.ndarray, width: float, height: float, nx: int = 20, ny: int = 20, step: float = 0.25, bonus: float = 1.0, gap: float = 0.0) -> float:
    """Needleman-Wunsch score of cell sequences, each cell repeated for every started ``step`` seconds; substitution falls with distance."""
    a, b = (scanmatch_cells(z, width, height, nx, ny, step) for z in (p, q))
    if not a or not b:
        return float("nan")
    top = math.hypot(nx - 1, ny - 1)
    u, v = np.array(a, float), np.array(b, float)
    cost = 2 * np.hypot(u[:, None, 0] - v[:, 0], u[:, None, 1] - v[:, 1]) / top - bonus
    return needleman_wunsch(a, b, bonus, gap, cost) / (bonus * max(len(a), len(b)))


def _mannan_distance(s: np.ndarray, t: np.ndarray, width: float, height: float) -> float:
    d = _distances(s, t) ** 2
    n, m = d.shape
    return math.sqrt((m * d.min(1).sum() + n * d.min(0).sum()) / (2 * n * m * (width**2 + height**2)))


@lru_cache(maxsize=1 << 16)
def mannan_chance(n: int, m: int, width: float, height: float, rounds: int, seed: int) -> float:
    """Mean distance of random scanpaths, which depends on the lengths only."""
    rng, found = np.random.default_rng(seed), np.empty(rounds)
    # some rounds at once, drawn in the same order
    many = max(1, 20_000 // max(1, n * m))
    held = np.empty((2, many, n, m))
    for a in range(0, rounds, many):
        both = rng.uniform(0, 1, (min(many, rounds - a), n + m, 2)) * (width, height)
        s, t = both[:, :n], both[:, n:]
        d, other = held[:, : len(both)]
        for axis, z in enumerate((d, other)):
            np.subtract(s[:, :, None, axis], t[:, None, :, axis], out=z)
            z *= z
        d += other
        to, back = np.sqrt(d.min(2)) ** 2, np.sqrt(d.min(1)) ** 2
        found[a : a + len(d)] = np.sqrt((m * to.sum(1) + n * back.sum(1)) / (2 * n * m * (width**2 + height**2)))
    return float(np.mean(found))


def mannan(p: np.ndarray, q: np.ndarray, width: float, height: float, rounds: int = 1000, seed: int = 0) -> float:
    """100 (1 - D / mean D of random scanpaths) with D the linear distance of nearest points both ways."""
    return 100 * (1 - _mannan_distance(p, q, width, height) / mannan_chance(len(p), len(q), width, height, rounds, seed))


# ---------------------------------------------------------------- spectra and fluctuation


def spectral_density(x: np.ndarray, y: np.ndarray, fs: float, segment: int | None = None, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided cross-spectral density (power where x is y): constant detrend, half-overlapping segments, mean over them."""
    n = max(len(x), len(y))
    x, y = (np.pad(np.asarray(z, float), (0, n - len(z))) for z in (x, y))
    m = min(segment or n, n)
    if m < 1:
        return np.zeros(0), np.zeros(0, complex)
    taper = np.ones(m) if window == "boxcar" else 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(m) / m)
    step = m if segment is None or m == n else m - m // 2
    out = []
    for a in range(0, n - m + 1, step):
        fx, fy = (np.fft.rfft((z[a : a + m] - z[a : a + m].mean()) * taper) for z in (x, y))
        out.append(np.conj(fx) * fy)
    p = np.mean(out, 0) / (fs * (taper**2).sum())
    p[1 : None if m % 2 else -1] *= 2
    return np.fft.rfftfreq(m, 1 / fs), p


def coherency(x: np.ndarray, y: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude-squared coherence."""
    f, pxy = spectral_density(x, y, fs, segment)
    pxx, pyy = spectral_density(x, x, fs, segment)[1].real, spectral_density(y, y, fs, segment)[1].real
    return f, np.abs(pxy) ** 2 / (pxx * pyy + 1e-30)


def dfa(x: np.ndarray, scales: list[int], order: int = 2, overlap: bool = False) -> np.ndarray:
    """Root mean square residual of piecewise polynomials, from both ends, per segment length."""
    out = np.full(len(scales), np.nan)
    for k, w in enumerate(scales):
        step = max(1, w // 2) if overlap else w
        parts = [z[a : a + w] for z in (x, x[::-1]) for a in range(0, len(x) - w + 1, step)]
        if w > order and parts:
            t = np.arange(w)
            basis = np.vander(t / w, order + 1)
            s = np.array(parts, float).T
            res = s - basis @ np.linalg.lstsq(basis, s, rcond=None)[0]
            out[k] = math.sqrt((res**2).mean())
    return out


def loglog_slope(t: np.ndarray, v: np.ndarray) -> float:
    """Slope of ln v over ln t on positive finite points."""
    ok = np.isfinite(v) & (v > 0) & (t > 0)
    return float(np.polyfit(np.log(t[ok]), np.log(v[ok]), 1)[0]) if ok.sum() > 1 else float("nan")


def sublevel_bars(x: np.ndarray, least: float = 0.0) -> list[tuple[float, float]]:
    """Persistence bars of sublevel components of a series, the oldest one up to the maximum; bars of at least ``least``."""
    order, parent, birth, bars = np.argsort(x, kind="stable"), {}, {}, []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in map(int, order):
        parent[i], birth[i] = i, float(x[i])
        for j in (i - 1, i + 1):
            if j in parent:
                a, b = sorted((find(i), find(j)), key=lambda r: (birth[r], r))
                if a != b:
                    if x[i] - birth[b] >= least and x[i] > birth[b]:
                        bars.append((birth[b], float(x[i])))
                    parent[b] = a
    if len(x) and float(np.ptp(x)) >= least:
        bars.append((float(x.min()), float(x.max())))
    return sorted(bars)


def sine_fit(t: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float, float]:
    """Amplitude, angular frequency, phase and offset of a sine, by Levenberg-Marquardt from the spectrum's peak."""
    power = np.abs(np.fft.rfft(y - y.mean()))
    freq = np.fft.rfftfreq(len(t), t[1] - t[0])
    p = np.array([y.std() * math.sqrt(2), 2 * math.pi * freq[1 + int(power[1:].argmax())], 0.0, y.mean()])
    base = np.stack([np.sin(p[1] * t), np.cos(p[1] * t), np.ones_like(t)], 1)
    a, b, c = np.linalg.lstsq(base, y, rcond=None)[0]
    p = np.array([math.hypot(a, b), p[1], math.atan2(b, a), c])
    damp = 1e-3
    model = lambda q: q[0] * np.sin(q[1] * t + q[2]) + q[3]
    err = ((y - model(p)) ** 2).sum()
    for _ in range(rounds):
        inner = p[1] * t + p[2]
        jac = np.stack([np.sin(inner), p[0] * t * np.cos(inner), p[0] * np.cos(inner), np.ones_like(t)], 1)
        h = jac.T @ jac
        q = p + np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), jac.T @ (y - model(p)))
        new = ((y - model(q)) ** 2).sum()
        p, err, damp = (q, new, damp / 3) if new < err else (p, err, damp * 3)
    return tuple(map(float, p))


def gamma_shape(v: np.ndarray) -> float:
    """Maximum-likelihood shape of a gamma distribution of positive values (three or more), by Newton steps."""
    v = v[np.isfinite(v) & (v > 0)]
    if len(v) < 3 or np.ptp(v) == 0:
        return float("nan")
    s = math.log(v.mean()) - np.log(v).mean()
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(20):
        h = 1e-5 * k
        psi = lambda z: (math.lgamma(z + h) - math.lgamma(z - h)) / (2 * h)
        tri = (math.lgamma(k + h) - 2 * math.lgamma(k) + math.lgamma(k - h)) / h**2
        k = max(1e-6, k - (math.log(k) - psi(k) - s) / (1 / k - tri))
    return float(k)


def _gamma_profile(v: np.ndarray, gap: float) -> tuple[float, float]:
    """Log likelihood and shape of the best gamma distribution that starts ``gap`` below the least value."""
    u = v - v.min() + gap
    k = gamma_shape(u)
    if not k > 0:
        return -math.inf, k
    scale = u.mean() / k
    return float(((k - 1) * np.log(u) - u / scale).sum() - len(u) * (math.lgamma(k) + k * math.log(scale))), k


def gamma_shape_shifted(v: np.ndarray, points: int = 40, rounds: int = 40) -> float:
    """Shape of a gamma distribution with a free start (three or more positive values): the best likelihood over starts below the least value, by its profile.

    Starts go from a thousandth to a thousand deviations below, the best of a grid is refined by golden sections; null for equal values.
    """
    v = v[np.isfinite(v) & (v > 0)]
    if len(v) < 3 or np.ptp(v) == 0:
        return float("nan")
    grid = np.linspace(math.log(1e-3), math.log(1e3), points) + math.log(v.std())
    at = int(np.argmax([_gamma_profile(v, math.exp(g))[0] for g in grid]))
    lo, hi = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(rounds):
        one, two = hi - golden * (hi - lo), lo + golden * (hi - lo)
        if _gamma_profile(v, math.exp(one))[0] >= _gamma_profile(v, math.exp(two))[0]:
            hi = two
        else:
            lo = one
    return _gamma_profile(v, math.exp((lo + hi) / 2))[1]


def approximate_entropy(e: np.ndarray, window: int, tolerance: float) -> float:
    """Mean log share of windows within the tolerance (largest difference), length ``window`` less one more; null for series that hold no longer window."""
    if len(e) < window + 1:
        return float("nan")
    phi = []
    for m in (window, window + 1):
        w = np.lib.stride_tricks.sliding_window_view(e, m)
        rows = max(1, HELD_DISTANCES // (len(w) * m))
        near = np.concatenate([(np.abs(w[a : a + rows, None] - w) < tolerance).all(2).sum(1) for a in range(0, len(w), rows)])
        phi.append(np.log(near / len(w)).mean())
    return float(phi[0] - phi[1])


#: Distances that a kernel holds at a time.
HELD_DISTANCES = 4_000_000


def area_names(label: np.ndarray) -> list[str]:
    """Names of areas by number: letters for up to 26, then A and a number padded alike."""
    top = int(label.max(initial=0))
    return [chr(65 + int(c)) for c in label] if top < 26 else [f"A{int(c):0{len(str(top))}d}" for c in label]


# ---------------------------------------------------------------- shapes


def convex_hull(pts: np.ndarray) -> np.ndarray:
    """Hull vertices counter-clockwise (monotone chain)."""
    pts = sorted({(float(x), float(y)) for x, y in np.round(pts, 6)})
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon_area(poly: np.ndarray) -> float:
    x, y = poly[:, 0], poly[:, 1]
    return float(0.5 * abs(x @ np.roll(y, -1) - y @ np.roll(x, -1))) if len(poly) > 2 else float("nan")


def voronoi_areas(pts: np.ndarray, width: float, height: float) -> np.ndarray:
    """Areas of the cells of distinct points, clipped to the plane.

    A cell is cut by its nearest points first; those whose bisector misses it are passed over together.
    """
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return np.zeros(0)
    out = []
    for k, p in enumerate(pts):
        cell = [(-p[0], -p[1]), (width - p[0], -p[1]), (width - p[0], height - p[1]), (-p[0], height - p[1])]
        far = np.delete(pts, k, 0) - p
        half = (far * far).sum(1) / 2
        order = half.argsort(kind="stable")
        far, half = far[order].T, half[order]
        while len(half) and len(cell) > 2:
            # beyond a bisector, of each corner (rows) and other point
            side = np.array(cell) @ far - half
            cut = (side > 0).any(0)
            at = int(cut.argmax())
            if not cut[at]:
                break
            over, new = side[:, at].tolist(), []
            for a, (x, y) in enumerate(cell):
                b = (a + 1) % len(cell)
                if over[a] <= 0:
                    new.append((x, y))
                if (over[a] < 0) != (over[b] < 0) and over[a] != over[b]:
                    t = over[a] / (over[a] - over[b])
                    new.append((x + (cell[b][0] - x) * t, y + (cell[b][1] - y) * t))
            cell, far, half = new, far[:, at + 1 :], half[at + 1 :]
        out.append(polygon_area(np.array(cell)) if len(cell) > 2 else 0.0)
    return np.array(out)


def hilbert_index(x: int, y: int, order: int) -> int:
    """Place of a cell on the Hilbert curve of a 2**order square."""
    d, s = 0, 2 ** (order - 1)
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        x, y, s = x & (s - 1), y & (s - 1), s // 2
    return d


def higuchi(values: np.ndarray, k_max: int = 10) -> float:
    """Higuchi exponent: slope of the mean curve length over 1 / k; k up to half of the points. Lengths are not divided by k a second time, so it is the fractal dimension less one."""
    n, lens, ks = len(values), [], []
    for k in range(1, min(k_max, n // 2) + 1):
        per = [np.abs(np.diff(values[m::k])).sum() * (n - 1) / (((n - 1 - m) // k) * k) for m in range(k) if (n - 1 - m) // k > 0]
        if per and np.mean(per) > 0:
            lens.append(math.log(np.mean(per)))
            ks.append(math.log(1 / k))
    return float(np.polyfit(ks, lens, 1)[0]) if len(ks) > 1 else float("nan")


# ---------------------------------------------------------------- clusters and models


def kmeans(pts: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from a seeded k-means++ start."""
    rng = np.random.default_rng(seed)
    x, y = pts[:, 0].astype(float), pts[:, 1].astype(float)
    c = np.empty((k, 2))
    c[0] = pts[int(rng.integers(len(pts)))]
    d = np.full(len(pts), np.inf)
    for j in range(1, k):
        d = np.minimum(d, (x - c[j - 1, 0]) ** 2 + (y - c[j - 1, 1]) ** 2)
        c[j] = pts[int(rng.choice(len(pts), p=d / d.sum()))] if d.sum() else pts[0]
    label = np.full(len(pts), -1)
    for _ in range(rounds):
        new = ((x[:, None] - c[:, 0]) ** 2 + (y[:, None] - c[:, 1]) ** 2).argmin(1)
        if (new == label).all():
            break
        label = new
        size = np.bincount(label, minlength=k)
        some = size > 0
        for axis, v in enumerate((x, y)):
            c[some, axis] = np.bincount(label, v, k)[some] / size[some]
    return label


def silhouette(pts: np.ndarray, label: np.ndarray, d: np.ndarray | None = None) -> float:
    """Mean silhouette; ``d`` are the points' distances, if known."""
    if d is None:
        d = np.hypot(pts[:, None, 0] - pts[:, 0], pts[:, None, 1] - pts[:, 1])
    ks = np.unique(label)
    if len(ks) < 2:
        return -1.0
    mean = np.stack([d[:, label == k].sum(1) for k in ks], 1)
    size = np.array([(label == k).sum() for k in ks])
    own = np.searchsorted(ks, label)
    at = np.arange(len(pts))
    a = mean[at, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[at, own] = np.inf
    b = other.min(1)
    return float(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0).mean())


def kmeans_auto(pts: np.ndarray, most: int = 15) -> np.ndarray:
    """k-means with the number of clusters of the best silhouette."""
    top = min(most, len(np.unique(pts, axis=0)) - 1)
    if top < 2:
        return np.zeros(len(pts), int)
    d = np.hypot(pts[:, None, 0] - pts[:, 0], pts[:, None, 1] - pts[:, 1])
    return max((kmeans(pts, k) for k in range(2, top + 1)), key=lambda z: silhouette(pts, z, d))


class Grid:
    """Points sorted by square cells of a side, so that those of a cell lie together."""

    def __init__(self, pts: np.ndarray, side: float):
        self.pts, self.side = pts, side
        self.cell = np.floor((pts - pts.min(0)) / side).astype(np.int64)
        self.wide = int(self.cell[:, 1].max()) + 1
        number = self.cell[:, 0] * self.wide + self.cell[:, 1]
        self.order = np.argsort(number, kind="stable")
        self.names, self.first = np.unique(number[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(pts))
        self.place = {int(c): k for k, c in enumerate(self.names)}

    def members(self, k: int) -> np.ndarray:
        return self.order[self.first[k] : self.last[k]]

    def around(self, k: int, reach: int) -> list[int]:
        """Filled cells up to ``reach`` away, that cell included."""
        cx, cy = divmod(int(self.names[k]), self.wide)
        ys = range(max(0, cy - reach), min(self.wide - 1, cy + reach) + 1)
        return [self.place[n] for i in range(max(0, cx - reach), cx + reach + 1) for j in ys if (n := i * self.wide + j) in self.place]


def _within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """How many points of ``b`` are within ``eps`` of each point of ``a``, some distances at a time."""
    rows = max(1, HELD_DISTANCES // max(len(b), 1))
    return np.concatenate([(np.hypot(a[i : i + rows, None, 0] - b[:, 0], a[i : i + rows, None, 1] - b[:, 1]) <= eps).sum(1) for i in range(0, len(a), rows)] or [np.zeros(0, int)])


def _touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any two points of ``a`` and ``b`` are within ``eps``; only those near the other's box are compared."""
    a = a[((a >= b.min(0) - eps) & (a <= b.max(0) + eps)).all(1)]
    if len(a):
        b = b[((b >= a.min(0) - eps) & (b <= a.max(0) + eps)).all(1)]
    return any(_within(a[i : i + 256], b, eps).any() for i in range(0, len(a), 256)) if len(a) and len(b) else False


def dbscan(pts: np.ndarray, eps: float, fewest: int = 5) -> np.ndarray:
    """Density clusters, numbered by their first core point; -1 for noise. A border point of several goes to the first.

    In cells whose diagonal is ``eps`` all points are neighbours, so a full cell is one
    piece of a cluster: only cells are joined, and no table of distances is kept.
    """
    label = np.full(len(pts), -1)
    if not len(pts):
        return label
    grid = Grid(pts, eps / math.sqrt(2) if eps > 0 else 1.0)
    core, n = np.zeros(len(pts), bool), len(grid.names)
    for k in range(n):
        own = grid.members(k)
        if len(own) >= fewest and eps > 0:
            core[own] = True
        else:
            near = np.concatenate([grid.members(j) for j in grid.around(k, 2)])
            core[own] = _within(pts[own], pts[near], eps) >= fewest
    cores = [m[core[m]] for m in map(grid.members, range(n))]
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    # a cell of one side eps / sqrt(2) may hold cores that are no neighbours only if eps is 0
    pieces = [k for k in range(n) if len(cores[k])]
    for k in pieces:
        for j in grid.around(k, 2):
            if j > k and len(cores[j]) and find(j) != find(k) and _touch(pts[cores[k]], pts[cores[j]], eps):
                root[find(j)] = find(k)
    found: dict[int, int] = {}
    for k in pieces:
        found[find(k)] = min(found.get(find(k), len(pts)), int(cores[k].min()))
    number = {r: i for i, (r, _) in enumerate(sorted(found.items(), key=lambda x: x[1]))}
    for k in pieces:
        label[cores[k]] = number[find(k)]
    for k in range(n):
        own = grid.members(k)
        rest = own[~core[own]]
        if len(rest):
            for j in sorted((j for j in grid.around(k, 2) if len(cores[j])), key=lambda j: -number[find(j)]):
                hit = _within(pts[rest], pts[cores[j]], eps) > 0
                label[rest[hit]] = number[find(j)]
    return label


def to_nearest_centre(pts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Points of noise (-1) go to the cluster whose centre is nearest; without clusters all stay."""
    names = np.unique(label[label >= 0])
    if not len(names):
        return label
    centres = np.array([pts[label == c].mean(0) for c in names])
    far = np.hypot(pts[:, None, 0] - centres[:, 0], pts[:, None, 1] - centres[:, 1])
    return np.where(label >= 0, label, names[far.argmin(1)])


def _rows_of(n: int) -> range:
    return range(0, n, max(1, HELD_DISTANCES // max(n, 1)))


def density_peaks(pts: np.ndarray, radius: float) -> np.ndarray:
    """Centres where density times distance to a denser point exceeds its weighted geometric mean; points go to the nearest centre.

    Densities have nine decimals, so that equal ones stay equal in whatever order they are summed.
    Distances are made some rows at a time; the time grows with the square of the points, the memory doesn't.
    """
    n, step = len(pts), _rows_of(len(pts)).step
    far = lambda rows: np.sqrt((pts[rows, None, 0] - pts[:, 0]) ** 2 + (pts[rows, None, 1] - pts[:, 1]) ** 2)
    rho = np.concatenate([np.floor((np.exp(-((far(slice(a, a + step)) / radius) ** 2)).sum(1) - 1) * 1e9 + 0.5) / 1e9 for a in _rows_of(n)])
    delta = np.empty(n)
    for a in _rows_of(n):
        d = far(slice(a, a + step))
        denser = np.where(rho[None, :] > rho[a : a + step, None], d, np.inf).min(1)
        delta[a : a + step] = np.where(np.isfinite(denser), denser, d.max(1))
    g = rho * delta
    ok = g > 0
    cut = math.exp((g[ok] * np.log(g[ok])).sum() / g[ok].sum()) if ok.any() else 0.0
    centres = np.flatnonzero(g > cut)
    if not len(centres):
        return np.zeros(n, int)
    rows = max(1, HELD_DISTANCES // len(centres))
    return np.concatenate([np.sqrt((pts[a : a + rows, None, 0] - pts[centres, 0]) ** 2 + (pts[a : a + rows, None, 1] - pts[centres, 1]) ** 2).argmin(1) for a in range(0, n, rows)])


def _disc_means(modes: np.ndarray, grid: Grid, sums: np.ndarray, radius: float) -> np.ndarray:
    """Mean of the points within ``radius`` of each mode: whole cells by their sums, those on the rim point by point; few points by all distances."""
    if len(grid.pts) * len(modes) <= HELD_DISTANCES:
        near = np.hypot(modes[:, None, 0] - grid.pts[:, 0], modes[:, None, 1] - grid.pts[:, 1]) <= radius
        return np.where(near.any(1)[:, None], (near @ grid.pts) / np.maximum(near.sum(1), 1)[:, None], modes)
    pts, side, low = grid.pts, grid.side, grid.pts.min(0)
    reach = math.ceil(radius / side)
    total, count = np.zeros((len(modes), 2)), np.zeros(len(modes))
    cell = np.floor((modes - low) / side).astype(np.int64)
    for key in np.unique(cell, axis=0):
        here = np.flatnonzero((cell == key).all(1))
        m = modes[here]
        for i in range(int(key[0]) - reach, int(key[0]) + reach + 1):
            for j in range(max(0, int(key[1]) - reach), min(grid.wide - 1, int(key[1]) + reach) + 1):
                k = grid.place.get(i * grid.wide + j) if i >= 0 else None
                if k is None:
                    continue
                corner = low + np.array([i, j]) * side
                near = np.maximum(np.maximum(corner - m, m - corner - side), 0)
                most = np.maximum(np.abs(m - corner), np.abs(m - corner - side))
                inside = np.hypot(*most.T) <= radius * (1 - 1e-12)
                total[here[inside]] += sums[k]
                count[here[inside]] += grid.last[k] - grid.first[k]
                rim = np.flatnonzero(~inside & (np.hypot(*near.T) <= radius * (1 + 1e-12)))
                if len(rim):
                    own = pts[grid.members(k)]
                    rows = max(1, HELD_DISTANCES // len(own))
                    for a in range(0, len(rim), rows):
                        r = rim[a : a + rows]
                        hit = np.hypot(m[r, None, 0] - own[:, 0], m[r, None, 1] - own[:, 1]) <= radius
                        total[here[r]] += hit @ own
                        count[here[r]] += hit.sum(1)
    return np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], modes)


def mean_shift(pts: np.ndarray, bandwidth: float, rounds: int = 100, orphans: bool = True) -> np.ndarray:
    """Flat-kernel mean shift; modes closer than the bandwidth are one. Without ``orphans`` points farther than the bandwidth from their mode are noise (-1).

    Modes are found by a grid of an eighth of the bandwidth; equal ones move as one.
    """
    pts = np.asarray(pts, float)
    if not len(pts):
        return np.zeros(0, int)
    grid = Grid(pts, bandwidth / 8)
    sums = np.add.reduceat(pts[grid.order], grid.first, axis=0)
    modes, of = np.unique(pts, axis=0, return_inverse=True)
    for _ in range(rounds):
        new = _disc_means(modes, grid, sums, bandwidth)
        moved = np.abs(new - modes).max()
        if moved < 1e-3 * bandwidth:
            break
        modes, merged = np.unique(new, axis=0, return_inverse=True)
        of = merged.ravel()[of.ravel()]
    modes = modes[of.ravel()]
    centres = np.zeros((0, 2))
    label = np.zeros(len(pts), int)
    for i, m in enumerate(modes):
        hit = np.flatnonzero(np.hypot(*(centres - m).T) < bandwidth)
        if len(hit):
            label[i] = hit[0]
        else:
            label[i] = len(centres)
            centres = np.vstack([centres, m])
    if not orphans:
        label[np.hypot(*(pts - centres[label]).T) > bandwidth] = -1
    return label


#: Points for which affinity propagation passes messages between all.
AFFINITY_POINTS = 3_000


def _messages(s: np.ndarray, to: np.ndarray, own: np.ndarray, damping: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and availabilities after ``rounds``, in memory that is used again.

    Ends before where the rest is known: responsibilities and their sums with similarities
    are as some rounds ago, and no availability has moved by more than these sums can show;
    then only the rest of the cycle is left to do.
    """
    n = len(s)
    at, dense = np.arange(n), s.shape[1] == n
    r, a, both, more = (np.zeros(s.shape) for _ in range(4))
    flat = at * s.shape[1] + own
    tie = (np.abs(s) + 1e-9) * 1e-17
    kept_r, kept_a, kept, left = r.copy(), a.copy(), 0, rounds
    keep, rest = damping, 1 - damping
    while left:
        np.add(a, s, out=both)
        top = both.argmax(1)
        best = at * s.shape[1] + top
        first = both.ravel()[best]
        both.ravel()[best] = -np.inf
        second = both.max(1)
        np.subtract(s, first[:, None], out=more)
        more.ravel()[best] = s.ravel()[best] - second
        more *= rest
        r *= keep
        r += more
        np.maximum(r, 0.0, out=both)
        both.ravel()[flat] = r.ravel()[flat]
        total = both.sum(0) if dense else np.bincount(to.ravel(), both.ravel(), n)[to]
        np.subtract(total, both, out=more)
        self_ = more.ravel()[flat]
        np.minimum(more, 0.0, out=more)
        more.ravel()[flat] = self_
        more *= rest
        a *= keep
        a += more
        left -= 1
        done = rounds - left
        if (r[0] == kept_r[0]).all() and np.array_equal(r, kept_r) and (np.abs(a - kept_a) <= tie).all():
            left %= done - kept
            kept_r[0, 0] = np.nan
        elif done % 24 == 0:
            kept_r[:], kept_a[:], kept = r, a, done
    return r, a


def affinity_propagation(pts: np.ndarray, damping: float = 0.8, rounds: int = 1000, neighbours: int | None = None) -> np.ndarray:
    """Exemplars by message passing; preferences are the median similarity, and clusters of one point join the nearest other.

    Messages go between all points, at most ``AFFINITY_POINTS`` of them, or from each to its ``neighbours`` nearest, however many there are.
    """
    n = len(pts)
    if neighbours is None and n > AFFINITY_POINTS:
        raise ValueError(f"{n} points are too many for messages between all; give a number of neighbours")
    width = n if neighbours is None else min(n, neighbours + 1)
    at = np.arange(n)
    if width == n:
        to = np.tile(at, (n, 1))
    else:
        near = np.empty((n, width), np.int64)
        for a in _rows_of(n):
            d = ((pts[a : a + _rows_of(n).step, None] - pts) ** 2).sum(2)
            d[np.arange(len(d)), a + np.arange(len(d))] = -1
            near[a : a + len(d)] = np.argpartition(d, width - 1, 1)[:, :width]
        to = np.sort(near, 1)
    s = -((pts[:, None] - pts[to]) ** 2).sum(2)
    own = (to == at[:, None]).argmax(1)
    s[at, own] = np.median(s)
    # ties fall by place
    s = s + (at[:, None] * n + to) * (1e-9 / max(n * n - 1, 1))
    r, a = _messages(s, to, own, damping, rounds)
    centres = np.flatnonzero((a + r)[at, own] > 0)
    if not len(centres):
        return np.zeros(n, int)
    nearest = lambda c: np.concatenate([((pts[i : i + 1024, None] - pts[c]) ** 2).sum(2).argmin(1) for i in range(0, n, 1024)])
    label = nearest(centres)
    label[centres] = np.arange(len(centres))
    big = np.flatnonzero(np.bincount(label, minlength=len(centres)) > 1)
    return big[nearest(centres[big])] if len(big) else label


def gaussian_hmm_2d(pts: np.ndarray, k: int, rounds: int = 10, spread: float = 2500.0) -> dict[str, np.ndarray]:
    """Full-covariance Gaussian model of fixations by scaled Baum-Welch, started at k-means centres."""
    n = len(pts)
    first = kmeans(pts, k)
    mean = np.array([pts[first == j].mean(0) if (first == j).any() else pts.mean(0) for j in range(k)])
    cov = np.stack([np.eye(2) * spread] * k)
    pi, trans = np.full(k, 1 / k), np.full((k, k), 1 / k)
    for _ in range(rounds):
        diff = pts[:, None] - mean
        inv = np.linalg.inv(cov)
        b = np.exp(-0.5 * np.einsum("tki,kij,tkj->tk", diff, inv, diff)) / (2 * math.pi * np.sqrt(np.linalg.det(cov))) + 1e-300
        alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            z = pi * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
            scale[t] = z.sum()
            alpha[t] = z / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        if n > 1:
            xi = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, b[1:] * beta[1:] / scale[1:, None])
            trans = xi / np.maximum(xi.sum(1, keepdims=True), 1e-12)
        pi, weight = gamma[0], np.maximum(gamma.sum(0), 1e-12)
        mean = gamma.T @ pts / weight[:, None]
        diff = pts[:, None] - mean
        cov = np.einsum("tk,tki,tkj->kij", gamma, diff, diff) / weight[:, None, None] + 1e-6 * np.eye(2)
    return {"pi": pi, "transitions": trans, "means": mean, "covariances": cov, "labels": gamma.argmax(1), "gamma": gamma, "log_likelihood": np.array(np.log(scale).sum())}


def hmm_moments(model: dict[str, np.ndarray], pts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """States' posteriors (samples x states), expected transitions (states x states) and log likelihood of points under a Gaussian model."""
    mean, cov, trans = model["means"], model["covariances"], model["transitions"]
    n, k = len(pts), len(mean)
    diff = pts[:, None] - mean
    log_b = -0.5 * np.einsum("tki,kij,tkj->tk", diff, np.linalg.inv(cov), diff) - math.log(2 * math.pi) - 0.5 * np.log(np.linalg.det(cov))
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    alpha, beta, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
    for t in range(n):
        z = model["pi"] * b[0] if t == 0 else (alpha[t - 1] @ trans) * b[t]
        scale[t] = max(z.sum(), 1e-300)
        alpha[t] = z / scale[t]
    for t in range(n - 2, -1, -1):
        beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-300)
    joint = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, b[1:] * beta[1:] / scale[1:, None]) if n > 1 else np.zeros((k, k))
    return gamma, joint, float((np.log(scale) + top).sum())


def hmm_gradient(model: dict[str, np.ndarray], pts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the log likelihood by transitions, means and covariances (taken as free symmetric matrices), with the states' occupancies and expected transitions."""
    gamma, joint, _ = hmm_moments(model, pts)
    trans, inv = model["transitions"], np.linalg.inv(model["covariances"])
    by_trans = np.divide(joint, trans, out=np.zeros_like(joint), where=trans > 0)
    diff = pts[:, None] - model["means"]
    by_mean = np.einsum("kij,tk,tkj->ki", inv, gamma, diff)
    scatter = np.einsum("tk,tki,tkj->kij", gamma, diff, diff)
    occupancy = gamma.sum(0)
    by_cov = 0.5 * (inv @ scatter @ inv - occupancy[:, None, None] * inv)
    return by_trans, by_mean, 0.5 * (by_cov + by_cov.transpose(0, 2, 1)), occupancy, joint


def fisher_vector(model: dict[str, np.ndarray], pts: np.ndarray, skip_low_occupancy: bool = True, upper: bool = True, by_row: bool = True, least: float = 1e-8, regularise: float = 1e-6) -> np.ndarray:
    """Gradients of the log likelihood per sample, by transitions, then state by state by mean and covariance; power and length normalised.

    ``skip_low_occupancy`` leaves out (as zeros) means and covariances of states whose
    posteriors sum to less than ``least``, ``upper`` keeps the covariances' upper
    triangles only, ``by_row`` divides transitions by their row's expected number;
    ``regularise`` is added to the covariances' diagonals.
    """
    n, d = pts.shape
    model = model | {"covariances": model["covariances"] + regularise * np.eye(d)}
    by_trans, by_mean, by_cov, occupancy, joint = hmm_gradient(model, pts)
    if by_row:
        by_trans = by_trans / np.maximum(joint.sum(1, keepdims=True), 1e-12)
    states = np.concatenate([by_mean, by_cov[:, *np.triu_indices(d)] if upper else by_cov.reshape(len(by_cov), -1)], 1)
    if skip_low_occupancy:
        states = np.where(occupancy[:, None] < least, 0.0, states)
    v = np.concatenate([by_trans.ravel(), states.ravel()]) / max(n, 1)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / max(np.linalg.norm(v), 1e-12)


def transition_entropies(p: np.ndarray, tolerance: float = 1e-12, rounds: int = 100_000) -> dict[str, float | list[float]]:
    """Stationary, joint and conditional entropy and mutual information of a transition matrix, the last two also by row; empty rows count as uniform."""
    p = np.where(p.sum(1, keepdims=True) > 0, p, 1 / len(p))
    p = p / p.sum(1, keepdims=True)
    pi = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = pi @ p
        if np.abs(new - pi).max() < tolerance:
            pi = new
            break
        pi = new
    log = lambda z: np.log(np.where(z > 0, z, 1))
    joint = pi[:, None] * p
    by_row = -(p * log(p)).sum(1)
    shared = np.where((p > 0) & (pi > 0), joint * (log(p) - log(pi)), 0).sum(1)
    return {
        "stationary": float(-(pi * log(pi)).sum()),
        "joint": float(-(joint * log(joint)).sum()),
        "conditional": float(pi @ by_row),
        "mutual_information": float(shared.sum()),
        "conditional_by_row": by_row.tolist(),
        "mutual_information_by_row": shared.tolist(),
    }


def direction_histograms(x: np.ndarray, y: np.ndarray, reach: int, bins: int = 36, bounds: np.ndarray | None = None) -> np.ndarray:
    """I-HOV features: distance-weighted histograms of directions to past, to future and from past to future samples, each turned so that its largest bin is first and smoothed; three times ``bins`` columns. Recordings follow each other between ``bounds``."""
    n, out = len(x), np.zeros((len(x), 3 * bins))
    start, past = _ends(n, bounds)
    here, off = np.arange(n)[:, None], np.arange(1, reach + 1)
    back, on = here - off[::-1], here + off
    inside = back >= start[:, None], on < past[:, None]
    sets = [(here, back, inside[0]), (here, on, inside[1]), (here - off, on, inside[0][:, ::-1] & inside[1])]
    for k, (one, two, known) in enumerate(sets):
        one, two = np.where(known, one, 0), np.where(known, two, 0)
        dx, dy = x[two] - x[one], y[two] - y[one]
        at = ((np.arctan2(dy, dx) + math.pi) / (2 * math.pi) * bins).astype(int) % bins
        h = np.bincount((here * bins + at)[known], np.hypot(dx, dy)[known], n * bins).reshape(n, bins)
        h = np.take_along_axis(h, (h.argmax(1)[:, None] + np.arange(bins)) % bins, 1)
        h = h / np.maximum(h.sum(1, keepdims=True), 1e-12)
        h = (np.roll(h, 1, 1) + h + np.roll(h, -1, 1)) / 3
        out[:, k * bins : (k + 1) * bins] = h / np.maximum(h.sum(1, keepdims=True), 1e-12)
    return out


#: Features of I-FC in the order of their columns.
IFC = ("acceleration", "bcea", "delta_bcea", "delta_rms", "delta_std_x", "delta_std_y", "dispersion", "i2mc", "mean_dist", "med_dist", "rms", "sf", "std_x", "std_y", "velocity", "z_ray")


def ifc_features(g: dict[str, np.ndarray], fs: float, probability: float = 0.68, i2mc: bool = True, i2mc_window: float = 0.2, i2mc_step: float = 0.02, bounds: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """The published features of I-FC for each sample of a recording, in the order of their names; all windows are symmetric frames, the first or last sample beyond the ends.

    ``g`` holds x, y, theta_x, theta_y, ux, uy, uz (unit gaze vector) and speed. Frames are
    50 ms to each side (11 ms for directions); differences take the frames 50 ms ahead and behind.
    Recordings follow each other between ``bounds``.
    """
    n = len(g["x"])
    start, past = _ends(n, bounds)
    last, alone = np.flatnonzero(np.arange(n) == past - 1), (past - start == 1)[:, None]
    wide, narrow = max(1, math.ceil(0.050 * fs)), max(1, math.ceil(0.011 * fs))
    near = lambda reach: np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1), start[:, None], past[:, None] - 1)
    w, s = near(wide), near(narrow)

    def steps(v: np.ndarray) -> np.ndarray:
        d = np.diff(v, append=v[-1:])
        d[last] = d[last - 1]
        return np.where(alone[:, 0], 0.0, d)

    unit = np.stack([g["ux"], g["uy"], g["uz"]], 1)
    angle = np.degrees(np.arccos(np.clip((unit[:-1] * unit[1:]).sum(1), -1, 1)))
    angle = np.append(angle, np.zeros(min(n, 1)))
    angle[last] = angle[last - 1]
    angle = np.where(alone[:, 0], 0.0, angle)
    turn = np.arctan2(steps(g["y"]) + 1e-12, steps(g["x"]) + 1e-12)
    tx, ty = g["theta_x"][w], g["theta_y"][w]
    std = np.stack([tx.std(1), ty.std(1)])
    dx, dy = tx - tx.mean(1, keepdims=True), ty - ty.mean(1, keepdims=True)
    norm = np.sqrt((dx**2).sum(1) * (dy**2).sum(1))
    r = np.clip(np.divide((dx * dy).sum(1), norm, out=np.zeros(n), where=norm > 0), -1, 1)
    rms = np.sqrt((angle[w] ** 2).mean(1))
    # points on a line have no area
    bcea = 2 * math.pi * -math.log(1 - probability) * std[0] * std[1] * np.sqrt(np.where(1 - r * r < 1e-9, 0, 1 - r * r))
    behind, ahead = np.maximum(start, np.arange(n) - wide), np.minimum(past - 1, np.arange(n) + wide)

    def apart(v: np.ndarray) -> np.ndarray:
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return np.degrees(np.arccos(np.clip((v[ahead] * v[behind]).sum(1), -1, 1)))

    out = {
        "acceleration": steps(g["speed"]),
        "bcea": bcea,
        "delta_bcea": bcea[ahead] - bcea[behind],
        "delta_rms": rms[ahead] - rms[behind],
        "delta_std_x": std[0][ahead] - std[0][behind],
        "delta_std_y": std[1][ahead] - std[1][behind],
        "dispersion": np.ptp(tx, axis=1) + np.ptp(ty, axis=1),
        "mean_dist": apart(unit[w].mean(1)),
        "med_dist": apart(np.median(unit[w], axis=1)),
        "rms": rms,
        "sf": np.full(n, float(fs)),
        "std_x": std[0],
        "std_y": std[1],
        "velocity": g["speed"],
        "z_ray": (np.cos(turn)[s].mean(1) ** 2 + np.sin(turn)[s].mean(1) ** 2) * s.shape[1],
    }
    if i2mc:
        half = max(1, math.floor(i2mc_window * fs / 2))
        out["i2mc"] = np.nan_to_num(two_means_weights(g["theta_x"], g["theta_y"], 2 * half + 1, max(1, math.ceil(i2mc_step * fs)), bounds))
    names = [k for k in IFC if k in out]
    return names, np.array([out[k] for k in names]).T


def _medians(v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Median of each row's known values, at least one."""
    v = np.sort(np.where(known, v, np.inf), 1)
    n, at = known.sum(1), np.arange(len(v))
    return (v[at, (n - 1) // 2] + v[at, n // 2]) / 2


def sample_features(x: np.ndarray, y: np.ndarray, speed: np.ndarray, wide: int, narrow: int, bounds: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """I-FC features per sample over clipped windows, in the order of their names; recordings follow each other between ``bounds``."""
    n = len(x)
    start, past = _ends(n, bounds)
    here = np.arange(n)

    def frames(reach: int) -> tuple[np.ndarray, np.ndarray]:
        at = here[:, None] + np.arange(-reach, reach + 1)
        known = (at >= start[:, None]) & (at < past[:, None])
        return np.where(known, at, here[:, None]), known

    w, known = frames(wide)
    s, _ = frames(narrow)  # beyond the ends its own sample, which changes no maximum
    count = known.sum(1)
    total = lambda v, k=known: np.where(k, v, 0.0).sum(1)
    xs, ys = x[w], y[w]
    dx, dy = xs - (total(xs) / count)[:, None], ys - (total(ys) / count)[:, None]
    less = np.maximum(count - 1, 1)
    sx, sy = np.sqrt(total(dx * dx) / less), np.sqrt(total(dy * dy) / less)
    both = sx * sy
    r = np.divide(total(dx * dy), less * both, out=np.zeros(n), where=both > 0)
    dist = np.hypot(dx, dy)
    # steps to the next sample, none from a recording's last
    nx, ny = np.append(np.diff(x), np.zeros(min(n, 1))), np.append(np.diff(y), np.zeros(min(n, 1)))
    step = np.hypot(nx, ny)
    ux, uy = nx / np.maximum(step, 1e-12), ny / np.maximum(step, 1e-12)
    inner, steps = w[:, :-1], known[:, :-1] & known[:, 1:]
    # a half of a frame from its sample on, or up to it
    before, after = slice(0, wide + 1), slice(wide, None)
    halves = [(v[:, h], known[:, h]) for v in (xs, ys) for h in (before, after)]
    mean = [total(v, k) / k.sum(1) for v, k in halves]
    median = [_medians(v, k) for v, k in halves]
    prev, next_ = np.maximum(here - 1, start), np.minimum(here + 1, past - 1)
    acc = np.abs((speed[next_] - speed[prev]) / np.maximum(next_ - prev, 1))
    cols = {
        "acceleration": acc[s].max(1),
        "bcea": 2 * math.pi * 1.1394342831883648 * sx * sy * np.sqrt(np.maximum(0.0, 1 - r * r)),
        "delta_mean": np.hypot(mean[1] - mean[0], mean[3] - mean[2]),
        "delta_median": np.hypot(median[1] - median[0], median[3] - median[2]),
        "dispersion": np.ptp(xs, axis=1) + np.ptp(ys, axis=1),
        "distance_mean": total(dist) / count,
        "distance_median": _medians(dist, known),
        "rayleigh_z": (total(ux[inner], steps) ** 2 + total(uy[inner], steps) ** 2) / less,
        "rms": np.sqrt(total(step[inner] ** 2, steps) / less),
        "std": np.sqrt(sx * sx + sy * sy),
        "velocity": speed[s].max(1),
    }
    names = sorted(cols)
    return names, np.array([cols[k] for k in names]).T
