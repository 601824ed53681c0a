"""Dynamic programs of one recording against many partners at once.

Tables are walked by anti-diagonals whose cells lie row by row with the partners side
by side, so each step is a few numpy calls on contiguous memory. Partners of like
length share a batch; cells beyond a partner's end are computed and never read.
Values and ways back are those of the kernels of one pair in ``kernels.py``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from . import kernels as K

#: Cells of one diagonal of all partners of a batch, so that a step stays in the cache; bytes of ways back that a batch keeps.
DIAGONAL, WAYS = 16_000, 4_000_000
#: A word whose bits are all set; words of a batch of tables, and sequences of one.
ONES, WORDS, QUERIES = np.uint64(2**64 - 1), 32_000, 64


class Columns(tuple):
    """Many rows of a kernel, column by column; a single value stands for all rows."""


def by_length(n: int, sizes: np.ndarray, cells: int, ways: bool = False) -> Iterator[np.ndarray]:
    """Places of partners, like lengths together, so many that ``n`` cells of each are about ``cells``."""
    order = np.argsort(sizes, kind="stable")
    a = 0
    while a < len(order):
        b = min(len(order), a + max(1, cells // (n + 1)))
        if ways:
            b = min(b, a + max(1, WAYS // ((n + 1) * (n + 1 + int(sizes[order[b - 1]])))))
        yield order[a:b]
        a = b


def padded(vs: list[np.ndarray], fill: float, dtype: type = float) -> np.ndarray:
    """Partners as columns, filled up below."""
    sizes = np.array([len(v) for v in vs])
    out = np.full((len(vs), int(sizes.max(initial=0))), fill, dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(vs)
    return np.ascontiguousarray(out.T)


def diagonals(n: int, m: int) -> Iterator[tuple[int, slice, slice, slice]]:
    """For each anti-diagonal: its number, rows of the table, rows above, and the second sequence's places in reverse."""
    for k in range(2, n + m + 1):
        lo, hi = max(1, k - m), min(n, k - 1)
        yield k, slice(lo, hi + 1), slice(lo - 1, hi), slice(m - k + lo, m - k + hi + 1)


def _apart(p: np.ndarray, vs: list[np.ndarray]) -> tuple[int, Callable[[slice, slice], np.ndarray]]:
    """Longest partner, and the distances of a diagonal's cells."""
    x, y = (padded([w[c::2] for w in vs], 0.0)[::-1].copy() for c in (0, 1))
    px, py = p[:, 0, None].copy(), p[:, 1, None].copy()

    def far(above: slice, back: slice) -> np.ndarray:
        dx, dy = px[above] - x[back], py[above] - y[back]
        dx *= dx
        dy *= dy
        dx += dy
        return np.sqrt(dx, out=dx)

    return len(x), far


def warps(p: np.ndarray, vs: list[np.ndarray], kind: str, ways: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Warping distances to all partners and, if asked, the ways back: 0 the diagonal, 1 the first sequence's step, 2 the second's, by diagonal and row."""
    join, first = K.WARPS[kind]
    n, sizes = len(p), np.array([len(w) // 2 for w in vs])
    m, apart = _apart(p, vs)
    back = np.zeros((n + m + 1, n + 1, len(vs)), np.int8) if ways else None
    before, last, now = (np.full((n + 1, len(vs)), np.inf) for _ in range(3))
    before[0] = first
    out = np.empty(len(vs))
    for k, rows, above, rest in diagonals(n, m):
        diagonal, up, left = before[above], last[above], last[rows]
        side = np.minimum(diagonal, up)
        if ways:
            np.maximum((diagonal > up).view(np.int8), (left < side).view(np.int8) << 1, out=back[k, rows])
        now[rows] = join(apart(above, rest), np.minimum(side, left))
        # what lies beside the diagonal's cells belongs to an older one
        now[: rows.start] = np.inf
        now[rows.stop :] = np.inf
        done = sizes == k - n
        if done.any():
            out[done] = now[n, done]
        before, last, now = last, now, before
    return out, back


def warp_within(p: np.ndarray, vs: list[np.ndarray], limit: float, kind: str) -> np.ndarray:
    """Warping distances of at most ``limit``, infinity for the others; a partner leaves when two diagonals in a row exceed the limit."""
    join, first = K.WARPS[kind]
    n, sizes = len(p), np.array([len(w) // 2 for w in vs])
    x, y = (padded([w[c::2] for w in vs], 0.0)[::-1].copy() for c in (0, 1))
    m, live, out = len(x), np.arange(len(vs)), np.full(len(vs), np.inf)
    before, last = np.full((n + 1, len(vs)), np.inf), np.full((n + 1, len(vs)), np.inf)
    before[0] = first
    for k, rows, above, rest in diagonals(n, m):
        now = np.full((n + 1, len(live)), np.inf)
        far = np.sqrt((p[above, 0, None] - x[rest]) ** 2 + (p[above, 1, None] - y[rest]) ** 2)
        now[rows] = join(far, np.minimum(np.minimum(before[above], last[above]), last[rows]))
        done = sizes[live] == k - n
        if done.any():
            out[live[done]] = now[n, done]
        if k % 4 == 0 or done.any():
            # the first diagonal of all has no cell but the edges
            stay = ~done & (np.minimum(now.min(0), last.min(0)) <= limit)
            if not stay.any():
                break
            live, now, last, x, y = live[stay], now[:, stay], last[:, stay], x[:, stay], y[:, stay]
        before, last = last, now
    return np.where(out <= limit, out, np.inf)


def trace(back: np.ndarray, n: int, sizes: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of all partners' ways from the start, one after the other, and where each ends; with ``whole`` the table's edges are walked, too, and -1 is a gap."""
    p = np.arange(len(sizes))
    i, j = np.full(len(sizes), n), sizes.copy()
    left, right, count = [], [], np.zeros(len(sizes), int)
    while True:
        live = (i > 0) | (j > 0) if whole else (i > 0) & (j > 0)
        if not live.any():
            break
        code = back[i + j, i, p]
        if whole:
            left.append(np.where(code == 2, -1, i - 1))
            right.append(np.where(code == 1, -1, j - 1))
        else:
            left.append(i - 1)
            right.append(j - 1)
        count += live
        i = i - (live & (code != 2))
        j = j - (live & (code != 1))
    steps = len(left)
    keep = np.arange(steps)[::-1] < count[:, None]
    flat = [np.array(z, np.int32).reshape(steps, len(sizes)).T[:, ::-1][keep] for z in (left, right)]
    return flat[0], flat[1], np.concatenate([[0], np.cumsum(count)])


class WarpLinks:
    """Distance and linked places of the warping with each partner."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, one, v, ids, vs):
        p, sizes = v.reshape(-1, 2), np.array([len(w) // 2 for w in vs])
        for at in by_length(len(p), sizes, DIAGONAL, True):
            far, back = warps(p, [vs[k] for k in at], self.kind, True)
            left, right, ends = trace(back, len(p), sizes[at])
            yield Columns((one, ids[at], far, *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(z)) for z in (left, right))))


class Coded:
    """Kernels of symbol sequences; all symbols of a task are numbered once."""

    names: np.ndarray

    def start(self, values: list[np.ndarray]) -> list[np.ndarray]:
        self.names, code = np.unique(np.concatenate([np.asarray(v, object) for v in values]).astype(str), return_inverse=True) if values else (np.array([], str), np.array([], int))
        return np.split(code.astype(np.intp), np.cumsum([len(v) for v in values])[:-1])


def coded(values: list) -> list[np.ndarray]:
    """Symbols as numbers; a missing symbol has one, too."""
    sizes = [len(v) for v in values]
    code = pd.factorize(np.concatenate([*(np.asarray(v, object) for v in values), np.zeros(0, object)]), use_na_sentinel=False)[0].astype(np.intp)
    return np.split(code, np.cumsum(sizes)[:-1]) if sizes else []


def common_lengths(vs: list[np.ndarray]) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Lengths of the longest common subsequences of some coded sequences (rows) with all partners (columns).

    A row of a pair's table is the bits of one or more words; partners with as many words take each step together, against several sequences at once.
    """
    words = np.array([max(1, -(-len(v) // 64)) for v in vs], int)
    groups = []
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        sizes = np.array([len(vs[k]) for k in at])
        symbols, code = np.unique(np.concatenate([vs[k] for k in at]), return_inverse=True)
        owner = np.repeat(np.arange(len(at)), sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # the last is of symbols that no partner has
        masks = np.zeros((len(symbols) + 1, w, len(at)), np.uint64)
        np.bitwise_or.at(masks, (code, place // 64, owner), np.uint64(1) << (place % 64).astype(np.uint64))
        groups.append((at, symbols, masks))

    def lengths(queries: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(queries), len(vs)), np.int32)
        order = np.argsort([len(q) for q in queries], kind="stable")
        for at, symbols, masks in groups:
            w = masks.shape[1]
            many = max(1, WORDS // (w * len(at)))
            for a in range(0, len(order), many):
                part = order[a : a + many]
                steps = padded([queries[k] for k in part], -1, np.int64)
                code = np.searchsorted(symbols, steps)
                code[(steps < 0) | (symbols[np.minimum(code, len(symbols) - 1)] != steps) if len(symbols) else ...] = len(symbols)
                out[np.ix_(part, at)] = _rows(masks, code)
        return out

    return lengths


def _rows(masks: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Lengths by partners' bits for each symbol, and the sequences' symbols step by step."""
    shape = (code.shape[1], *masks.shape[1:])
    row, (hit, total), last = np.full(shape, ONES), np.empty((2, *shape), np.uint64), masks.shape[1] - 1
    for step in code:
        np.take(masks, step, 0, out=hit, mode="clip")
        np.bitwise_and(row, hit, out=hit)
        np.add(row, hit, out=total)
        if last:
            over = total[:, :last] < row[:, :last]
        for k in range(last):
            # what overflows goes on to the next word
            total[:, k + 1] += over[:, k]
            if k + 1 < last:
                over[:, k + 1] |= over[:, k] & (total[:, k + 1] == 0)
        # bits without a hit stay; the sum moves a hit to the end of its run
        np.bitwise_xor(row, hit, out=row)
        np.bitwise_or(row, total, out=row)
    return np.bitwise_count(~row).sum(1, dtype=np.int32)


class CommonLengths:
    """Length of the longest common subsequence with each partner, zeros left out."""

    def start(self, values: list[np.ndarray]) -> np.ndarray:
        """All sequences of a task as bits; a recording is its place from here on."""
        self.code = coded(values)
        self.lengths = common_lengths(self.code)
        return np.arange(len(values))

    def __call__(self, one, v, ids, vs):
        score = self.lengths([self.code[v]])[0][np.asarray(vs)]
        yield Columns((one, ids[score > 0], score[score > 0]))


class Alignments(Coded):
    """Edit distance and alignment with each partner, as pairs of symbols, ``_`` for a gap."""

    def __call__(self, one, v, ids, vs):
        n, sizes = len(v), np.array([len(w) for w in vs])
        for at in by_length(n, sizes, 2 * DIAGONAL, True):
            b = padded([vs[k] for k in at], -1, np.int32)[::-1].copy()
            m, a = len(b), v.astype(np.int32)[:, None]
            back = np.zeros((n + m + 1, n + 1, len(at)), np.int8)
            before, last, now = (np.zeros((n + 1, len(at)), np.int32) for _ in range(3))
            last[:2] = 1
            back[np.arange(1, n + 1), np.arange(1, n + 1)] = 1
            back[1:, 0] = 2
            score = np.zeros(len(at))
            for k, rows, above, rest in diagonals(n, m):
                pair = before[above] + (a[above] != b[rest])
                gap = last[above] + 1
                best = np.minimum(np.minimum(pair, gap), last[rows] + 1)
                off = pair > best
                np.add(off.view(np.int8), (off & (gap > best)).view(np.int8), out=back[k, rows])
                now[rows] = best
                now[0] = k
                if k <= n:
                    now[k] = k
                done = sizes[at] == k - n
                if done.any():
                    score[done] = now[n, done]
                before, last, now = last, now, before
            yield self.aligned(one, v, ids[at], [vs[k] for k in at], score, *trace(back, n, sizes[at], True))

    def aligned(self, one, v, ids, vs, score, left, right, ends) -> Columns:
        """Alignments as strings: numbers of pairs of symbols, looked up once."""
        owner, wide = np.repeat(np.arange(len(ids)), np.diff(ends)), len(self.names) + 1
        start = np.concatenate([[0], np.cumsum([len(w) for w in vs])])[:-1]
        mine = np.where(left >= 0, v[np.maximum(left, 0)], wide - 1)
        theirs = np.where(right >= 0, np.concatenate(vs)[start[owner] + np.maximum(right, 0)], wide - 1) if len(owner) else mine
        met, code = np.unique(mine * wide + theirs, return_inverse=True)
        names = [*self.names.tolist(), "_"]
        pairs = pa.array([names[c // wide] + names[c % wide] for c in met.tolist()], pa.string())
        return Columns((one, ids, score, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs.take(pa.array(code)))))


class LocalAlignments(Alignments):
    """Best local alignment with each partner, gaps of ``base + step * length``; ties fall as in ``kernels.local_alignment``."""

    def __init__(self, base: float = 0.1, step: float = 0.05):
        self.base, self.step = base, step

    def __call__(self, one, v, ids, vs):
        n, sizes = len(v), np.array([len(w) for w in vs])
        for at in by_length(n, sizes, DIAGONAL, True):
            b = padded([vs[k] for k in at], -1)
            m, count = len(b), len(at)
            h, most = np.zeros((n + 1, m + 1, count)), np.zeros((n + 1, count))
            # 0 the way's start, 1 a pair, 2 a gap
            code = np.zeros((n + 1, m + 1, count), np.int8)
            open_, ramp = np.full((m + 1, count), -np.inf), (self.step * np.arange(m + 1))[:, None]
            fits = {int(c): np.where(b == c, 1.0, -1.0) for c in np.unique(v)}
            beyond = np.flatnonzero(sizes[at] < m)
            for i in range(1, n + 1):
                np.maximum(open_, h[i - 1] - self.base, out=open_)
                open_ -= self.step
                row = np.maximum(0.0, open_, out=h[i])
                pair = h[i - 1, :-1] + fits[int(v[i - 1])]
                np.maximum(row[1:], pair, out=row[1:])
                row[0] = 0.0
                run = np.maximum.accumulate(row + ramp, 0)[:-1]
                run -= self.base
                run -= ramp[1:]
                np.maximum(row[1:], run, out=row[1:])
                for k in beyond:
                    row[sizes[at[k]] + 1 :, k] = 0.0
                most[i] = row.max(0)
                pair -= row[1:]
                np.abs(pair, out=pair)
                np.multiply((row[1:] > 0).view(np.int8), 1 + (pair >= 1e-9).view(np.int8), out=code[i, 1:])
            top = most.argmax(0)
            score = most[top, np.arange(count)]
            best = top * (m + 1) + (h[top, :, np.arange(count)] == score[:, None]).argmax(1)
            left, right, ends = self.ways(h, code, best)
            yield self.aligned(one, v, ids[at], [vs[k] for k in at], score, left, right, ends)

    def ways(self, h, code, best):
        """Ways back of all partners: a pair, else the shortest gap that fits in the second sequence, else in the first."""
        m1, count = h.shape[1], h.shape[2]
        p = np.arange(count)
        i, j = best // m1, best % m1
        left, right, many = [], [], np.zeros(count, int)
        side, rest = np.zeros(count, int), np.zeros(count, int)
        while True:
            fresh, step = rest == 0, code[i, j, p]
            live = ~fresh | (step > 0)
            if not live.any():
                break
            side[fresh] = 0
            rest[fresh & live] = 1
            new = np.flatnonzero(fresh & (step == 2))
            if len(new):
                a, c, here = i[new], j[new], h[i[new], j[new], new]
                for axis in (1, 2):
                    if not len(new):
                        break
                    place = a if axis == 1 else c
                    reach = np.arange(1, int(place.max(initial=0)) + 1)[:, None]
                    gone = place - reach
                    from_ = h[np.maximum(gone, 0), c, new] if axis == 1 else h[a, np.maximum(gone, 0), new]
                    fits = (gone >= 0) & (np.abs(from_ - self.base - self.step * reach - here) < 1e-9)
                    found = fits.any(0)
                    side[new[found]], rest[new[found]] = axis, fits.argmax(0)[found] + 1
                    new, a, c, here = new[~found], a[~found], c[~found], here[~found]
            left.append(np.where(side == 2, -1, i - 1))
            right.append(np.where(side == 1, -1, j - 1))
            many += live
            i = i - (live & (side != 2))
            j = j - (live & (side != 1))
            rest = rest - live
        steps = len(left)
        keep = np.arange(steps)[::-1] < many[:, None]
        flat = [np.array(z, np.int32).reshape(steps, count).T[:, ::-1][keep] for z in (left, right)]
        return flat[0], flat[1], np.concatenate([[0], np.cumsum(many)])


class EditMeasures(Coded):
    """The five measures of ``grouped.edit_metrics`` with each partner: a row a measure."""

    NAMES = ("levenshtein", "generalized_edit", "needleman_wunsch", "longest_common_subsequence", "smith_waterman")

    def __init__(self, centers: dict[str, tuple[float, float]]):
        self.centers = centers
        at = np.array(list(centers.values()), float).reshape(-1, 2)
        self.between = np.hypot(at[:, None, 0] - at[:, 0], at[:, None, 1] - at[:, 1])
        self.top = float(self.between.max(initial=0.0)) or 1.0

    def start(self, values):
        # symbols are numbered as the centres are, the last number fills up
        index = {name: n for n, name in enumerate(self.centers)}
        wide = len(index) + 1
        far = np.full((wide, wide), 1e300)
        far[:-1, :-1] = self.between / self.top
        self.far = far.ravel()
        self.fit = np.where(np.eye(wide, dtype=bool), 0.1, -far).ravel()
        return [np.array([index[s] for s in v], np.intp) for v in values]

    def __call__(self, one, v, ids, vs):
        n, sizes, wide = len(v), np.array([len(w) for w in vs]), len(self.centers) + 1
        out = np.empty((len(vs), 5))
        for at in by_length(n, sizes, DIAGONAL):
            b = padded([vs[k] for k in at], wide - 1, np.intp)[::-1].copy()
            m, a, own, count = len(b), v[:, None], (v * wide)[:, None], len(at)
            zero = lambda kind, fill=0: [np.full((n + 1, count), fill, kind) for _ in range(3)]
            (lev0, lev1, lev2), (lcs0, lcs1, lcs2), (gen0, gen1, gen2), (nw0, nw1, nw2), (sw0, sw1, sw2) = zero(np.int32), zero(np.int32), zero(float), zero(float), zero(float)
            # gaps down and to the right of the diagonal before
            down, right = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
            lev1[:2], gen1[:2], nw1[:2] = 1, 0.3, -0.25
            best = np.zeros(count)
            for k, rows, above, rest in diagonals(n, m):
                code = own[above] + b[rest]
                other = a[above] != b[rest]
                far = self.far.take(code, mode="clip")
                lev2[rows] = np.minimum(lev0[above] + other, np.minimum(lev1[above], lev1[rows]) + 1)
                lcs2[rows] = np.maximum(lcs0[above] + ~other, np.maximum(lcs1[above], lcs1[rows]))
                gen2[rows] = np.minimum(gen0[above] + far, np.minimum(gen1[above], gen1[rows]) + 0.3)
                nw2[rows] = np.maximum(nw0[above] + self.fit.take(code, mode="clip"), np.maximum(nw1[above], nw1[rows]) - 0.25)
                opened = sw1[above.start : rows.stop] - 0.1
                fall = np.maximum(down[above], opened[:-1])
                fall -= 0.05
                aside = np.maximum(right[rows], opened[1:], out=right[rows])
                aside -= 0.05
                down[rows] = fall
                np.maximum(fall, aside, out=fall)
                np.subtract(0.2, far, out=far)
                far += sw0[above]
                np.maximum(far, 0.0, out=far)
                h = np.maximum(far, fall, out=sw2[rows])
                best = np.maximum(best, h.max(0))
                lev2[0], gen2[0], nw2[0] = k, k * 0.3, -k * 0.25
                if k <= n:
                    lev2[k], gen2[k], nw2[k], sw2[k], lcs2[k] = k, k * 0.3, -k * 0.25, 0.0, 0
                    down[k], right[k] = -np.inf, -np.inf
                done = np.flatnonzero(sizes[at] == k - n)
                if len(done):
                    out[at[done], :4] = np.stack([z[n, done] for z in (lev2, gen2, nw2, lcs2)], 1)
                lev0, lev1, lev2, lcs0, lcs1, lcs2 = lev1, lev2, lev0, lcs1, lcs2, lcs0
                gen0, gen1, gen2, nw0, nw1, nw2, sw0, sw1, sw2 = gen1, gen2, gen0, nw1, nw2, nw0, sw1, sw2, sw0
            out[at, 4] = best
        longer = np.maximum(np.maximum(n, sizes), 1)
        out[:, 2] *= -1
        out[:, :4] /= longer[:, None]
        out[:, 4] /= longer * (0.2 * self.top)
        yield Columns((one, np.repeat(ids, 5), pa.DictionaryArray.from_arrays(np.tile(np.arange(5, dtype=np.int8), len(vs)), list(self.NAMES)).cast(pa.string()), out.ravel()))


class PathMeasures:
    """The measures of ``grouped.path_metrics`` with each partner: a row a measure.

    What depends on one scanpath alone (simplified saccades, cells) is made once a task; dtw, Frechet and the
    nearest points share the distances of a diagonal.
    """

    NAMES = ("dtw", "frechet", "multimatch_shape", "multimatch_length", "multimatch_angle", "multimatch_position", "multimatch_duration", "scanmatch", "mannan")

    def __init__(self, width: float, height: float, diagonal: float, step: float, rounds: int, chances: dict[tuple[int, int], float] | None = None):
        self.width, self.height, self.diagonal, self.step, self.rounds = width, height, diagonal, step, rounds
        self.chances = chances or {}

    def start(self, values):
        paths = [np.asarray(v, float).reshape(-1, 3) for v in values]
        cells = [K.scanmatch_cells(p, self.width, self.height, *K.SCANMATCH, self.step) for p in paths]
        number: dict = {}
        code = [np.array([number.setdefault(c, len(number)) for c in cs], np.intp) for cs in cells]
        self.cells = np.array(list(number), float).reshape(-1, 2)
        saccades = [K.simplify_scanpath(p, *K.simplification(self.diagonal)) for p in paths]
        # start, step, duration, length and direction
        saccades = [np.concatenate([s, np.hypot(s[:, 2], s[:, 3])[:, None], np.arctan2(s[:, 3], s[:, 2])[:, None]], 1) for s in saccades]
        return [(p, np.ascontiguousarray(p[:, :2]).ravel(), s, np.ascontiguousarray(s[:, 2:4]).ravel(), c) for p, s, c in zip(paths, saccades, code, strict=True)]

    def __call__(self, one, v, ids, vs):
        out = np.full((len(vs), 9), np.nan)
        sizes = np.array([len(w[0]) for w in vs])
        for at in by_length(len(v[0]), sizes, DIAGONAL):
            out[at, 0], out[at, 1], out[at, 8] = self.warped(v[0][:, :2], [vs[k][1] for k in at], sizes[at])
        sizes = np.array([len(w[2]) for w in vs])
        some = np.flatnonzero(sizes) if len(v[2]) else np.zeros(0, int)
        for part in by_length(len(v[2]), sizes[some], DIAGONAL, True):
            out[some[part], 2:7] = self.multimatch(v[2], [vs[k] for k in some[part]], sizes[some[part]])
        sizes, n = np.array([len(w[4]) for w in vs]), len(v[4])
        some = np.flatnonzero(sizes) if n else np.zeros(0, int)
        top = np.hypot(K.SCANMATCH[0] - 1, K.SCANMATCH[1] - 1)
        far = np.hypot(self.cells[v[4], None, 0] - self.cells[:, 0], self.cells[v[4], None, 1] - self.cells[:, 1])
        fit = np.concatenate([-(2 * far / top - 1.0), np.zeros((n, 1))], 1)
        for part in by_length(n, sizes[some], DIAGONAL):
            at = some[part]
            out[at, 7] = self.aligned(fit, [vs[k][4] for k in at], sizes[at]) / np.maximum(n, sizes[at])
        yield Columns((one, np.repeat(ids, 9), pa.DictionaryArray.from_arrays(np.tile(np.arange(9, dtype=np.int8), len(vs)), list(self.NAMES)).cast(pa.string()), out.ravel()))

    def warped(self, p, vs, sizes):
        """Dynamic time warping, Frechet and Mannan's measure."""
        n, count = len(p), len(vs)
        x, y = (padded([w[c::2] for w in vs], np.inf)[::-1].copy() for c in (0, 1))
        px, py, m = p[:, 0, None].copy(), p[:, 1, None].copy(), len(x)
        to, back = np.full((n, count), np.inf), np.full((m, count), np.inf)
        sum0, sum1, sum2, top0, top1, top2 = np.full((6, n + 1, count), np.inf)
        sum0[0], top0[0] = 0.0, -np.inf
        held, out = np.empty((3, n, count)), np.empty((2, count))
        for k, rows, above, rest in diagonals(n, m):
            far, other, least = held[:, : rows.stop - rows.start]
            np.subtract(px[above], x[rest], out=far)
            np.subtract(py[above], y[rest], out=other)
            far *= far
            other *= other
            far += other
            np.minimum(to[above], far, out=to[above])
            np.minimum(back[rest], far, out=back[rest])
            np.sqrt(far, out=far)
            for a, b, now, join in ((sum0, sum1, sum2, np.add), (top0, top1, top2, np.maximum)):
                np.minimum(a[above], b[above], out=least)
                np.minimum(least, b[rows], out=least)
                join(far, least, out=now[rows])
                # the next diagonals read one cell on either side
                now[rows.start - 1] = np.inf
                if rows.stop <= n:
                    now[rows.stop] = np.inf
            done = np.flatnonzero(sizes == k - n)
            if len(done):
                out[0, done], out[1, done] = sum2[n, done], top2[n, done]
            sum0, sum1, sum2, top0, top1, top2 = sum1, sum2, sum0, top1, top2, top0
        to, back = (np.ascontiguousarray((np.sqrt(z) ** 2).T) for z in (to, back[::-1]))
        back[np.arange(m) >= sizes[:, None]] = 0.0
        linear = np.sqrt((sizes * to.sum(1) + n * back.sum(1)) / (2 * n * sizes * (self.width**2 + self.height**2)))
        chance = {m: self.chance(n, m) for m in np.unique(sizes).tolist()}
        return *out, 100 * (1 - linear / np.array([chance[m] for m in sizes.tolist()]))

    def chance(self, n: int, m: int) -> float:
        found = self.chances.get((n, m))
        return K.mannan_chance(n, m, self.width, self.height, self.rounds, 0) if found is None else found

    def multimatch(self, s, vs, sizes):
        """Shape, length, angle, position and duration."""
        _, back = warps(s[:, 2:4], [w[3] for w in vs], "dtw", True)
        left, right, ends = trace(back, len(s), sizes)
        right = right + np.repeat(np.cumsum(sizes) - sizes, np.diff(ends))
        u, v = s.T.take(left, 1), np.concatenate([w[2] for w in vs]).T.take(right, 1)
        turn = np.abs(u[6] - v[6])
        turn = np.minimum(turn, 2 * np.pi - turn)
        diffs = (np.hypot(u[2] - v[2], u[3] - v[3]) / (2 * self.diagonal), np.abs(u[5] - v[5]) / self.diagonal, turn / np.pi, np.hypot(u[0] - v[0], u[1] - v[1]) / self.diagonal, np.abs(u[4] - v[4]) / np.maximum(np.maximum(u[4], v[4]), 1e-12))
        means = np.add.reduceat(np.stack(diffs), ends[:-1], axis=1) / np.diff(ends)
        return np.clip(1 - means, 0, 1).T

    def aligned(self, fit, vs, sizes):
        """Needleman-Wunsch scores without a cost of gaps by the fit of each own cell with each cell of the task."""
        n, wide, count = *fit.shape, len(vs)
        b = padded(vs, wide - 1, np.intp)[::-1].copy()
        m, fit, own = len(b), fit.ravel(), (np.arange(n) * wide)[:, None]
        before, last, now = np.zeros((3, n + 1, count))
        code, pair, out = np.empty((n, count), np.intp), np.empty((n, count)), np.empty(count)
        for k, rows, above, rest in diagonals(n, m):
            at, score = code[: rows.stop - rows.start], pair[: rows.stop - rows.start]
            np.add(own[above], b[rest], out=at)
            np.take(fit, at, out=score, mode="clip")
            score += before[above]
            np.maximum(score, last[above], out=score)
            np.maximum(score, last[rows], out=now[rows])
            # the table's edges
            now[0] = 0.0
            if k <= n:
                now[k] = 0.0
            done = np.flatnonzero(sizes == k - n)
            if len(done):
                out[done] = now[n, done]
            before, last, now = last, now, before
        return out


class CrossSpectra:
    """Cross spectra with each partner as ``kernels.spectral_density`` makes them: a recording's segments are transformed once, what lies beyond its end is zero."""

    def __init__(self, fs: float, segment: int | None):
        self.fs, self.segment = fs, segment

    def start(self, values):
        return [(np.asarray(v, float), self.waves(np.asarray(v, float)) if self.segment else None) for v in values]

    def waves(self, v: np.ndarray) -> np.ndarray:
        """Transforms of all segments that start inside the recording."""
        m, step = self.segment, self.segment - self.segment // 2
        count = -(-len(v) // step)
        cut = np.lib.stride_tricks.sliding_window_view(np.pad(v, (0, count * step + m)), m)[: count * step : step]
        return np.fft.rfft((cut - cut.mean(1, keepdims=True)) * _hann(m))

    def __call__(self, one, v, ids, vs):
        longer = np.maximum(len(v[0]), [len(w) for w, _ in vs])
        if not self.segment:
            for n in np.unique(longer).tolist():
                at = np.flatnonzero(longer == n)
                yield self.columns(one, ids[at], n, *self.whole(v[0], [vs[k][0] for k in at], n))
            return
        long = np.flatnonzero(longer >= self.segment)
        for a in range(0, len(long), 256):
            at = long[a : a + 256]
            yield self.columns(one, ids[at], self.segment, *self.parts(v[1], [vs[k][1] for k in at], longer[at]))
        for k in np.flatnonzero(longer < self.segment).tolist():
            x, y = (np.pad(z, (0, longer[k] - len(z))) for z in (v[0], vs[k][0]))
            p, coherency = (fn(x, y, self.fs, self.segment)[1][None] for fn in (K.spectral_density, K.coherency))
            yield self.columns(one, ids[k : k + 1], int(longer[k]), p, coherency)

    def whole(self, v, vs, n):
        x, y = (padded(z, 0.0).T for z in ([v], vs))
        x, y = (np.pad(z, ((0, 0), (0, n - z.shape[1]))) for z in (x, y))
        fx, fy = (np.fft.rfft((z - z.mean(1, keepdims=True)) * _hann(n)) for z in (x, y))
        return self.density(np.conj(fx) * fy, n, 1), None

    def parts(self, v, vs, longer):
        m = self.segment
        count = (longer - m) // (m - m // 2) + 1
        wide = max(len(v), *[len(w) for w in vs])
        own, others = np.zeros((wide, v.shape[1]), complex), np.zeros((len(vs), wide, v.shape[1]), complex)
        own[: len(v)] = v
        others[np.arange(wide) < np.array([len(w) for w in vs])[:, None]] = np.concatenate(vs)
        others[np.arange(wide) >= count[:, None]] = 0
        cross = (np.conj(own) * others).sum(1)
        power = np.cumsum(np.abs(own) ** 2, 0)[np.minimum(count, wide) - 1]
        cross, px, py = (self.density(z, m, count[:, None]) for z in (cross, power, (np.abs(others) ** 2).sum(1)))
        return cross, np.abs(cross) ** 2 / (px * py + 1e-30)

    def density(self, sums, m, count):
        with np.errstate(invalid="ignore", divide="ignore"):
            p = sums / count / (self.fs * (_hann(m) ** 2).sum())
        p[:, 1 : None if m % 2 else -1] *= 2
        return p

    def columns(self, one, ids, m, p, coherency) -> Columns:
        f = np.fft.rfftfreq(m, 1 / self.fs)
        n = p.size
        return Columns((one, np.repeat(ids, len(f)), np.tile(np.arange(len(f)), len(ids)), np.tile(f, len(ids)), p.real.ravel(), p.imag.ravel(), pa.nulls(n, pa.float64()) if coherency is None else coherency.ravel()))


def _hann(m: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
