"""All pairs of recordings, block by block.

Recordings are dealt over blocks by a hash of their id, and each pair of blocks is one
task that holds both and compares across (a block with itself compares within). So a
recording is shuffled once per block, not once per partner. The number of blocks
follows the measured size of the recordings: a block holds about ``BLOCK_BYTES`` of
points, however many recordings there are, and there are enough pairs of blocks for
all cores. A recording and its partners fit a worker; results leave it in batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import DIAGONAL, Columns, by_length, padded, warp_within

BLOCK_BYTES = 16_000_000
#: Distances that a kernel holds at a time, and rows in a batch of results.
CELLS, OUT_ROWS = 100_000, 20_000
#: Where so small a share of recordings are different, equal ones are dealt together and compared once; kinds of partners at a time.
ALIKE, KINDS = 0.7, 1024

#: id and values of a recording, ids and values of partners with larger ids -> rows in the order of the schema, or
#: ``Columns`` of many. A kernel with a method ``start`` gets all values of a task through it.
Kernel = Callable[[int, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[tuple]]


def blocks_for(packed: DataFrame, column: str) -> int:
    return _measured(packed, column)[0]


def _measured(packed: DataFrame, column: str) -> tuple[int, bool]:
    """Blocks of about ``BLOCK_BYTES``, and so many that their pairs occupy all cores about three times; and whether many recordings are equal."""
    size = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size(column)), F.lit(0)).alias("bytes"), F.approx_count_distinct(F.xxhash64(column)).alias("kinds")).first()
    cores = packed.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(size["bytes"] / BLOCK_BYTES), min(math.ceil(math.sqrt(6 * cores)), size["n"])), size["kinds"] < ALIKE * size["n"]


def dealt(packed: DataFrame, blocks: int, alike: str | None = None) -> DataFrame:
    """(low, high, home, recording_id, ...): each recording once for each block that its own one meets.

    With ``alike`` recordings with equal values there stay together, in blocks of about the same size all the same.
    """
    home = F.pmod(F.xxhash64("recording_id"), F.lit(blocks)).cast("int")
    if alike:
        packed, home = packed.repartitionByRange(blocks, F.xxhash64(alike), "recording_id"), F.spark_partition_id()
    met = packed.select("*", home.alias("home"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    return met.select(F.least("home", "met").alias("low"), F.greatest("home", "met").alias("high"), "home", *packed.columns)


def _values(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def compare(packed: DataFrame, kernel: Kernel, schema: str, column: str = "v", blocks: int | None = None) -> DataFrame:
    """Rows of ``kernel`` for all pairs of recordings, the smaller id first; ``packed`` has (recording_id, ``column`` an array)."""
    measured, alike = _measured(packed, column)
    blocks = blocks or measured
    cells = dealt(packed.select("recording_id", column), blocks, column if alike or isinstance(kernel, PointMapping) else None)
    kinds = T._parse_datatype_string(schema)
    # more partitions than pairs of blocks, so that hashes seldom put several into one task
    cells = cells.repartition(min(4 * blocks * (blocks + 1), 4096), "low", "high")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = key[0].as_py() == key[1].as_py()
        ids, homes, values = [], [], []
        for b in batches:
            ids.append(b.column("recording_id").to_numpy(zero_copy_only=False))
            homes.append(b.column("home").to_numpy(zero_copy_only=False))
            values += _values(b.column(column))
        number, home = np.concatenate(ids), np.concatenate(homes)
        order = np.argsort(number, kind="stable")
        number, home, values = number[order], home[order], [values[i] for i in order]
        rows: list[tuple] = []
        waiting, high = [], 0
        if isinstance(kernel, PointMapping | SubsequenceSimilarity):
            found = _each(kernel, number, home, values, same)
        else:
            kind, distinct = _numbered(values)
            found = _once(kernel, number, home, kind, distinct, same, arrow) if len(distinct) < ALIKE * len(values) else _each(kernel, number, home, values, same)
        for row in found:
            if isinstance(row, Columns):
                waiting.append(row)
                high += _height(row)
                if high >= OUT_ROWS:
                    yield from _batches(_joined(waiting), arrow)
                    waiting, high = [], 0
                continue
            rows.append(row)
            if len(rows) >= OUT_ROWS:
                yield batch(rows)
                rows = []
        if waiting:
            yield from _batches(_joined(waiting), arrow)
        yield batch(rows)

    arrow = _arrow_schema(kinds)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return cells.groupBy("low", "high").applyInArrow(run, schema)


def _each(kernel: Kernel, number: np.ndarray, home: np.ndarray, values: list[np.ndarray], same: bool) -> Iterator[tuple]:
    """Rows of all pairs of a task, recording by recording."""
    values = _started(kernel, values)
    # where values are numbers, equal ones follow each other
    for i in np.argsort(values, kind="stable") if isinstance(values, np.ndarray) else range(len(number)):
        with_ = np.flatnonzero((number > number[i]) & (same | (home != home[i])))
        if len(with_):
            yield from kernel(int(number[i]), values[i], number[with_], _at(values, with_))


def _once(kernel: Kernel, number: np.ndarray, home: np.ndarray, kind: np.ndarray, distinct: list[np.ndarray], same: bool, arrow: pa.Schema) -> Iterator[tuple]:
    """The same rows, those of equal recordings computed once for each of their partners' kinds and repeated; some kinds of partners at a time."""
    values = _started(kernel, distinct)
    order = np.argsort(kind, kind="stable")
    members = np.split(order, np.cumsum(np.bincount(kind, minlength=len(distinct)))[:-1])
    for k, mine in enumerate(members):
        met = np.zeros(len(distinct), bool)
        for i in mine:
            met[kind[(number > number[i]) & (same | (home != home[i]))]] = True
        needed = np.flatnonzero(met)
        for a in range(0, len(needed), KINDS):
            chosen = needed[a : a + KINDS]
            parts = _columns(kernel(0, values[k], chosen, _at(values, chosen)), arrow)
            if not parts:
                continue
            found = _joined(parts)
            of = np.asarray(found[1])
            by_kind = np.argsort(of, kind="stable")
            count = np.bincount(of, minlength=len(distinct))
            first = np.cumsum(count) - count
            inside = np.zeros(len(distinct), bool)
            inside[chosen] = True
            for i in mine:
                with_ = np.flatnonzero((number > number[i]) & (same | (home != home[i])) & inside[kind])
                n = count[kind[with_]]
                for b, e in _pieces(n):
                    m, w = n[b:e], with_[b:e]
                    at = by_kind[np.repeat(first[kind[w]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                    yield Columns((int(number[i]), np.repeat(number[w], m), *[c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] if isinstance(c, np.ndarray) else c for c in found[2:]]))


def _pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of partners with about ``OUT_ROWS`` rows."""
    edges = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(n) // OUT_ROWS, prepend=0)), [0, len(n)]))
    for b, e in zip(edges, edges[1:], strict=False):
        if n[b:e].any():
            yield int(b), int(e)


def _columns(found: Iterator[tuple], arrow: pa.Schema) -> list[Columns]:
    """Rows of a kernel as columns."""
    parts, rows = [], []
    for row in found:
        (parts if isinstance(row, Columns) else rows).append(row)
    parts = [c for c in parts if _height(c)]
    if rows:
        one, two, *others = zip(*rows, strict=True)
        parts.append(Columns((one[0], np.array(two), *[pa.array(c, f.type, from_pandas=True) for c, f in zip(others, list(arrow)[2:], strict=True)])))
    return parts


def _numbered(values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each recording the number of its kind, and a recording of each kind."""
    number: dict[bytes | tuple, int] = {}
    kind = np.array([number.setdefault(tuple(v) if v.dtype == object else v.tobytes(), len(number)) for v in values], int)
    return kind, [values[i] for i in np.unique(kind, return_index=True)[1]]


def _at(values: list | np.ndarray, places: np.ndarray) -> list | np.ndarray:
    return values[places] if isinstance(values, np.ndarray) else [values[j] for j in places]


def _started(kernel: Kernel, values: list[np.ndarray]) -> list[np.ndarray] | np.ndarray:
    return kernel.start(values) if hasattr(kernel, "start") else values


def _height(columns: Columns) -> int:
    return max((len(c) for c in columns if isinstance(c, np.ndarray | pa.Array)), default=0)


def _joined(parts: list[Columns]) -> Columns:
    """Rows of many calls as one: making a batch costs more than a few hundred rows in it."""
    if len(parts) == 1:
        return parts[0]
    high = list(map(_height, parts))
    return Columns(pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate([x if isinstance(x, np.ndarray) else np.full(n, x) for x, n in zip(c, high, strict=True)]) for c in zip(*parts, strict=True))


def _batches(columns: Columns, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = _height(columns)
    whole = [(c if isinstance(c, pa.Array) else pa.array(c if isinstance(c, np.ndarray) else np.full(n, c), f.type, from_pandas=True)) for c, f in zip(columns, arrow, strict=True)]
    made = pa.RecordBatch.from_arrays(whole, schema=arrow)
    for a in range(0, n, OUT_ROWS):
        yield made.slice(a, OUT_ROWS)


def _arrow_schema(kinds: T.StructType) -> pa.Schema:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.name, simple[f.dataType.simpleString()]) for f in kinds])


def given(packed: DataFrame, pairs: DataFrame, kernel: Kernel, schema: str, column: str = "v") -> DataFrame:
    """The same for a short list of pairs (id_1, id_2): both recordings are joined to each row."""
    joined = pairs.join(packed.select(F.col("recording_id").alias("id_1"), F.col(column).alias("one")), "id_1").join(packed.select(F.col("recording_id").alias("id_2"), F.col(column).alias("two")), "id_2")
    arrow = _arrow_schema(T._parse_datatype_string(schema))
    names = arrow.names

    def flat(row: tuple) -> list[tuple]:
        return [tuple(r.values()) for b in _batches(row, arrow) for r in b.to_pylist()] if isinstance(row, Columns) else [row]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = _started(kernel, [*b.one, *b.two])
            yield pd.DataFrame([r for a, c, v, w in zip(b.id_1, b.id_2, values[: len(b)], values[len(b) :], strict=True) for row in kernel(a, v, np.array([c]), [w]) for r in flat(row)], columns=names)

    return joined.mapInPandas(run, schema)


def between(packed: DataFrame, pairs: DataFrame | None, kernel: Kernel, schema: str, column: str = "v") -> DataFrame:
    return compare(packed, kernel, schema, column) if pairs is None else given(packed, pairs, kernel, schema, column)


def pack_points(df: DataFrame, columns: tuple[str, ...] = ("x", "y"), order: str = "k") -> DataFrame:
    """(recording_id, v array<double>): the ordered points of each recording, number after number."""
    points = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy("recording_id").agg(F.flatten(F.transform(points, lambda q: F.array(*[q[c].cast("double") for c in columns]))).alias("v"))


def pack_symbols(df: DataFrame, symbol: str = "aoi", order: str = "k") -> DataFrame:
    """(recording_id, v array<string>): the ordered symbols of each recording."""
    return df.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, symbol))), lambda s: s[symbol]).alias("v"))


def _r6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5001) / 1e6


def _chunks(n: int, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of partners whose distances to ``n`` points are about ``CELLS``."""
    start = total = 0
    for i, m in enumerate(sizes):
        if i > start and n * (total + m) > CELLS:
            yield start, i
            start, total = i, 0
        total += m
    if start < len(sizes):
        yield start, len(sizes)


def _runs(hit: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat start and length of runs of at least ``shortest`` along the last axis, whose last column is empty."""
    step = np.diff(np.concatenate([[False], hit.ravel(), [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = end - start >= shortest
    return start[keep], (end - start)[keep]


class _Squares:
    """Squared distances in memory that is used again: fresh pages cost more than the sums."""

    def __init__(self):
        self.held = np.empty((2, 0))

    def __call__(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of points ``p`` (n, 2) to partners' points (partners, m)."""
        shape = (len(x), len(p), x.shape[1])
        size = math.prod(shape)
        if self.held.shape[1] < size:
            self.held = np.empty((2, size))
        dx, dy = (z[:size].reshape(shape) for z in self.held)
        np.subtract(p[:, 0, None], x[:, None], out=dx)
        np.subtract(p[:, 1, None], y[:, None], out=dy)
        dx *= dx
        dy *= dy
        dx += dy
        return dx


def _stretches(hit: np.ndarray, step: int, most: int) -> list[np.ndarray]:
    """For each length from 1, how many stretches of so many hits each partner (a row of cells, lines parted by an empty one) has along a step; up to ``most``, or until there are none."""
    count = lambda z: np.array([np.count_nonzero(row) for row in z])
    now, out = hit, [count(hit)]
    while len(out) < most and out[-1].any() and now.shape[1] > step:
        now = now[:, :-step] & hit[:, len(out) * step :]
        out.append(count(now))
    return out


def cross_recurrence(radius: float, shortest: int = 3) -> Kernel:
    """Recurrence rate, laminarity of either direction, determinism and entropy of diagonal lines, null where undefined.

    A run of l hits has l - s + 1 stretches of s, so numbers of stretches tell how many runs of each length there are.
    """

    def in_runs(w: list[np.ndarray]) -> np.ndarray:
        w = w + [np.zeros_like(w[0])] * max(0, shortest + 1 - len(w))
        return shortest * w[shortest - 1] - (shortest - 1) * w[shortest]

    squares = _Squares()

    def kernel(one, v, ids, vs):
        p, sizes = v.reshape(-1, 2), np.array([len(w) // 2 for w in vs])
        n, out = len(p), np.empty((5, len(vs)))
        order = np.argsort(sizes, kind="stable")
        for a, b in _chunks(n, sizes[order].tolist()):
            at = order[a:b]
            # an infinite last point parts the lines of a table
            q = padded([vs[k] for k in at] + [np.full(2 * int(sizes[at[-1]]) + 2, np.inf)], np.inf).T[:-1]
            wide = q.shape[1] // 2
            hit = (squares(p, q[:, 0::2].copy(), q[:, 1::2].copy()) < radius * radius).reshape(len(at), -1)
            lines = _stretches(hit, wide + 1, 1 << 30)
            points = lines[0]
            vertical, horizontal = (in_runs(_stretches(hit, step, shortest + 1)) for step in (1, wide))
            lines += [np.zeros_like(points)] * max(2, shortest + 2 - len(lines))
            runs = lines[shortest - 1] - lines[shortest]
            entropy = np.zeros(len(at))
            with np.errstate(invalid="ignore", divide="ignore"):
                for k in range(shortest - 1, len(lines) - 2):
                    share = (lines[k] - 2 * lines[k + 1] + lines[k + 2]) / runs
                    entropy += np.where(share > 0, -share * np.log(share), 0.0)
                of_points = [np.where(points > 0, _r6(1e2 * z / points), np.nan) for z in (vertical, horizontal, in_runs(lines))]
            out[:, at] = [_r6(1e2 * points / (n * sizes[at])), *of_points, _r6(entropy)]
        yield Columns((one, ids, *out))

    return kernel


CROSS_RECURRENCE = "id_1 long, id_2 long, recurrence_rate double, laminarity_vertical double, laminarity_horizontal double, determinism double, entropy double"


def recurrence(p: np.ndarray, radius: float, shortest: int = 2) -> dict[str, float]:
    """Recurrence quantification of one scanpath: rate, laminarity, determinism, centre of mass, entropy of diagonal lines."""
    n = len(p)
    # rows in pieces, with an empty last column that parts them
    hit = np.zeros((n, n + 1), bool)
    rows = max(1, CELLS // max(n, 1))
    for a in range(0, n, rows):
        hit[a : a + rows, :n] = (p[a : a + rows, None, 0] - p[:, 0]) ** 2 + (p[a : a + rows, None, 1] - p[:, 1]) ** 2 < radius * radius
    hit[np.tril_indices(n)] = False
    i, j = np.nonzero(hit)
    points = len(i)
    vertical = _runs(hit, shortest)[1].sum()
    horizontal = _runs(np.concatenate([hit[:, :n].T, np.zeros((n, 1), bool)], 1), shortest)[1].sum()
    sheared = np.zeros((n, n + 1), bool)
    sheared[j - i, i] = True
    lines = _runs(sheared, shortest)[1]
    share = np.unique(lines, return_counts=True)[1] / max(len(lines), 1)
    nan = float("nan")
    return {
        "recurrence_rate": _r6(2e2 * points / (n * (n - 1))) if n > 1 else nan,
        "laminarity": _r6(5e1 * (vertical + horizontal) / points) if points else nan,
        "determinism": _r6(1e2 * lines.sum() / points) if points else nan,
        "corm": _r6(1e2 * (j - i).sum() / ((n - 1) * points)) if points else nan,
        "entropy": _r6(-(share * np.log(share)).sum()) + 0.0,
    }


def point_mapping(one, v, ids, vs):
    """Eye analysis distance and linear distance: nearest points both ways."""
    p, sizes = v.reshape(-1, 2), np.array([len(w) // 2 for w in vs])
    n, out = len(p), np.empty((2, len(vs)))
    px, py = p[:, 0, None].copy(), p[:, 1, None].copy()
    for at in by_length(n, sizes, min(DIAGONAL, CELLS)):
        # partners side by side, one place of all of them after the other
        x, y = (padded([vs[k][c::2] for k in at], np.inf) for c in (0, 1))
        to, back = np.full((n, len(at)), np.inf), np.empty(x.shape)
        d, dy = np.empty((2, n, len(at)))
        for j in range(len(x)):
            np.subtract(px, x[j], out=d)
            np.subtract(py, y[j], out=dy)
            d *= d
            dy *= dy
            d += dy
            np.minimum(to, d, out=to)
            np.min(d, 0, out=back[j])
        back[np.arange(len(x))[:, None] >= sizes[at]] = 0.0
        for z in (to, back):
            np.sqrt(z, out=z)
        s1, s2, q1, q2, m = to.sum(0), back.sum(0), (to * to).sum(0), (back * back).sum(0), sizes[at]
        out[:, at] = _r6((s1 + s2) / np.maximum(n, m)), _r6(np.sqrt((m * q1 + n * q2) / (2.0 * n * m)))
    yield Columns((one, ids, *out))


class PointMapping:
    """:func:`point_mapping`, equal scanpaths of a task compared once."""

    def start(self, values: list[np.ndarray]) -> np.ndarray:
        """A recording is the number of its scanpath from here on."""
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(np.asarray(v, float).tobytes(), len(number)) for v in values], int)
        self.paths = [np.frombuffer(b) for b in number]
        self.now, self.known, self.found = -1, np.zeros(len(number), bool), np.empty((2, len(number)))
        return at

    def __call__(self, one, v, ids, vs):
        vs = np.asarray(vs)
        if v != self.now:
            self.now, self.known[:] = v, False
        need = np.zeros(len(self.paths), bool)
        need[vs] = True
        new = np.flatnonzero(need & ~self.known)
        if len(new):
            ((_, _, *found),) = point_mapping(one, self.paths[v], new, [self.paths[k] for k in new])
            self.found[:, new], self.known[new] = found, True
        yield Columns((one, ids, *self.found[:, vs]))


POINT_MAPPING = "id_1 long, id_2 long, eye_analysis_distance double, linear_distance double"


def time_delay_embedding(length: int = 5) -> Kernel:
    """Distance of each run of points of the first scanpath to the nearest of the second: mean and largest, by the pair's largest coordinate; pairs with too short a scanpath are left out."""

    squares = _Squares()

    def kernel(one, v, ids, vs):
        sizes = np.array([len(w) // 2 for w in vs])
        long, p = np.flatnonzero(sizes >= length), v.reshape(-1, 2)
        if len(p) < length or not len(long):
            return
        own, out = len(p) - length + 1, np.empty((2, len(long)))
        order = long[np.argsort(sizes[long], kind="stable")]
        place = np.empty(len(vs), int)
        place[long] = np.arange(len(long))
        for a, b in _chunks(len(p), sizes[order].tolist()):
            at = order[a:b]
            q = padded([vs[k] for k in at], np.inf).T
            d = squares(p, q[:, 0::2].copy(), q[:, 1::2].copy())
            wide = d.shape[2] - length + 1
            far = d[:, :own, :wide].copy()
            for m in range(1, length):
                far += d[:, m : m + own, m : m + wide]
            least = np.sqrt(far.min(2))
            mean, most = least.mean(1), least.max(1)
            top = np.maximum(v.max(), [vs[k].max() for k in at])
            with np.errstate(invalid="ignore", divide="ignore"):
                out[:, place[at]] = np.where(top != 0, [_r6(mean / top), _r6(most / top)], np.nan)
        yield Columns((one, ids[long], *out))

    return kernel


TIME_DELAY = "id_1 long, id_2 long, mean_minimal double, hausdorff double"


class SubsequenceSimilarity:
    """One less half the difference of the n-gram frequencies of two symbol sequences; no row where neither has an n-gram.

    Frequencies of a sequence sum to one, so the similarity is the sum of the smaller frequencies of the n-grams that
    both have: each recording looks up who else of the task has its n-grams, and all partners' rows leave as columns.
    """

    def __init__(self, n: int = 3):
        self.n = n

    def start(self, values: list[np.ndarray]) -> np.ndarray:
        """Tables of n-grams by recording and of recordings by n-gram; a recording is its place from here on."""
        places, n = len(values), self.n
        sizes = np.array([len(v) for v in values], int)
        owner = np.repeat(np.arange(places), sizes)
        symbol = pd.factorize(np.concatenate([*values, np.zeros(0, object)]), use_na_sentinel=False)[0]
        gram = symbol[: max(0, len(symbol) - n + 1)]
        for m in range(1, n):
            # numbered anew at each step, so that numbers stay small
            gram = pd.factorize(gram * (len(symbol) + 1) + symbol[m : len(gram) + m])[0]
        inside = owner[: len(gram)] == owner[n - 1 :][: len(gram)]
        owner, gram = owner[: len(gram)][inside], gram[inside]
        wide = int(gram.max(initial=0)) + 1
        key, count = np.unique(owner * wide + gram, return_counts=True)
        owner, self.gram = key // wide, key % wide
        self.places, self.has = places, sizes >= n
        self.share = count / np.maximum(sizes - n + 1, 1)[owner]
        self.bounds = np.searchsorted(owner, np.arange(places + 1))
        order = np.argsort(self.gram, kind="stable")
        self.owner, self.held = owner[order], self.share[order]
        self.holders = np.bincount(self.gram, minlength=wide)
        self.first = np.cumsum(self.holders) - self.holders
        return np.arange(places)

    def __call__(self, one, v, ids, vs):
        vs, own = np.asarray(vs), slice(*self.bounds[v : v + 2])
        grams = self.gram[own]
        count = self.holders[grams]
        at = np.repeat(self.first[grams] - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(self.owner[at], np.minimum(np.repeat(self.share[own], count), self.held[at]), self.places)[vs]
        has = self.has[vs]
        if self.has[v]:
            yield Columns((one, ids, np.where(has, _r6(both), 0.5)))
        elif has.any():
            yield Columns((one, ids[has], 0.5))


SUBSEQUENCES = "id_1 long, id_2 long, similarity double"


def joint_bins(nx: int, ny: int) -> Kernel:
    """Points of both scanpaths in the cells of the pair's joint extent."""

    def kernel(one, v, ids, vs):
        p, sizes = v.reshape(-1, 2), np.array([len(w) // 2 for w in vs])
        first = np.cumsum(sizes) - sizes
        q = np.concatenate(vs).reshape(-1, 2)
        wide = np.maximum(p.max(0), np.maximum.reduceat(q, first)) + 0.001
        step, found = wide / (nx, ny), []
        for side, owner, cell in (
            (1, np.repeat(np.arange(len(vs)), len(p)), np.floor(np.minimum(p, wide[:, None] - 0.001) / step[:, None]).reshape(-1, 2)),
            (2, np.repeat(np.arange(len(vs)), sizes), np.floor(np.minimum(q, np.repeat(wide - 0.001, sizes, 0)) / np.repeat(step, sizes, 0))),
        ):
            cell = cell.astype(np.int64)
            key = (owner * (2 * nx) + cell[:, 0] + nx) * (2 * ny) + cell[:, 1] + ny
            if len(cell) and ((cell < (-nx, -ny)) | (cell >= (nx, ny))).any():
                # cells far below zero: any number of them
                rows, count = np.unique(np.stack([owner, *cell.T], 1), axis=0, return_counts=True)
                found.append((rows[:, 0], side, rows[:, 1], rows[:, 2], count))
                continue
            count = np.bincount(key, minlength=1)
            key = np.flatnonzero(count)
            found.append((key // (4 * nx * ny), side, key // (2 * ny) % (2 * nx) - nx, key % (2 * ny) - ny, count[key]))
        for owner, side, gx, gy, count in found:
            yield Columns((one, ids[owner], side, gx, gy, count))

    return kernel


JOINT_BINS = "id_1 long, id_2 long, side int, gx long, gy long, n long"


def near_pairs(limit: float, kind: str = "frechet") -> Kernel:
    """Pairs of scanpaths whose warping distance is at most ``limit``.

    First and last points are linked in any warping, so their distances bound it from
    below for all partners at once; the others' tables end as soon as two diagonals in a row exceed the limit.
    """

    def kernel(one, v, ids, vs):
        p = v.reshape(-1, 2)
        first, last = (np.array([w[e : e + 2] if e >= 0 else w[-2:] for w in vs]) for e in (0, -1))
        start, end = np.hypot(*(first - p[0]).T), np.hypot(*(last - p[-1]).T)
        single = np.array([len(p) == 1 and len(w) == 2 for w in vs])
        least = np.maximum(start, end) if kind == "frechet" else np.where(single, start, start + end)
        close = np.flatnonzero(least <= limit)
        for at in by_length(len(p), np.array([len(vs[k]) // 2 for k in close]), DIAGONAL):
            far = warp_within(p, [vs[k] for k in close[at]], limit, kind)
            hit = far <= limit
            if hit.any():
                yield Columns((one, ids[close[at[hit]]], far[hit]))

    return kernel


NEAR = "id_1 long, id_2 long, distance double"
