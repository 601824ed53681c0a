"""Nearest neighbours among all training points, exact, in two rounds.

Training points lie in cells of a tree of splits, about equally many in each. A row asks the cell whose box is
nearest first; then it goes to those cells only whose box is no farther than the last of the neighbours it has.
Inside a cell points lie in leaves with boxes of their own, which are passed over in the same way. A task holds one
cell and a batch of rows, the driver the cells' boxes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a leaf, and rows that ask at a time.
LEAF, ROWS = 256, 2048
#: Points a cell that tell where space is cut; all points count whatever the cuts.
CUT_POINTS = 64


def halves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of points by halving along the axis that varies most, until at most ``size`` are left."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        axis, middle = x[at].var(0).argmax(), len(at) // 2
        at = at[np.argpartition(x[at, axis], middle)]
        todo += [at[middle:], at[:middle]]
    return out


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, axis after axis, so that a pair's does not depend on what else is asked."""
    out = np.zeros((len(x), len(points)))
    for a, b in zip(x.T, points.T, strict=True):
        d = a[:, None] - b
        d *= d
        out += d
    return out


def to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances to boxes, no larger than those to any point inside, rounding included."""
    out = np.zeros((len(x), len(low)))
    for a, b, c in zip(x.T, low.T, high.T, strict=True):
        d = np.maximum(b - a[:, None], a[:, None] - c)
        np.maximum(d, 0.0, out=d)
        d *= d
        out += d
    return out


class Leaves:
    """Points of a cell and their labels."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, size: int = LEAF):
        parts = halves(points, size)
        self.points, self.labels = [points[p] for p in parts], [labels[p] for p in parts]
        self.low, self.high = (np.array([f(p, 0) for p in self.points]) for f in (np.min, np.max))

    def nearest(self, x: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and labels of the ``k`` nearest points no farther than ``bound`` (squared), by distance and label; infinity and -1 where there are fewer."""
        far, label = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
        limit, boxes = bound.copy(), to_boxes(x, self.low, self.high)

        def ask(leaf: int, at: np.ndarray) -> None:
            d = squares(x[at], self.points[leaf])
            better = np.flatnonzero(d.min(1) <= limit[at])
            if not len(better):
                return
            at, d = at[better], d[better]
            # all points as near as the k-th count, so that labels decide between them
            within = np.minimum(limit[at], np.partition(d, k - 1, 1)[:, k - 1]) if d.shape[1] > k else limit[at]
            row, point = np.nonzero(d <= within[:, None])
            rows = np.concatenate([np.repeat(np.arange(len(at)), k), row])
            all_far = np.concatenate([far[at].ravel(), d[row, point]])
            all_label = np.concatenate([label[at].ravel(), self.labels[leaf][point]])
            order = np.lexsort((all_label, all_far, rows))
            first = np.searchsorted(rows[order], np.arange(len(at)))
            taken = order[first[:, None] + np.arange(k)]
            far[at], label[at] = all_far[taken], all_label[taken]
            limit[at] = np.minimum(limit[at], far[at, -1])

        # the nearest boxes first, row by row, for a small limit
        for _ in range(min(3, len(self.points))):
            near = boxes.argmin(1)
            order = np.argsort(near, kind="stable")
            ends = np.searchsorted(near[order], np.arange(len(self.points) + 1))
            for leaf in np.flatnonzero(np.diff(ends)):
                at = order[ends[leaf] : ends[leaf + 1]]
                ask(leaf, at[boxes[at, leaf] <= limit[at]])
            boxes[np.arange(len(x)), near] = np.inf
        for leaf in np.flatnonzero((boxes <= limit[:, None]).any(0)):
            at = np.flatnonzero((boxes[:, leaf] <= limit) & np.isfinite(boxes[:, leaf]))
            if len(at):
                ask(leaf, at)
        return far, label


def _cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of the cut at each node of a full tree, node after node."""
    axis, place = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
    held = {0: x}
    for node in range(len(axis)):
        p = held.pop(node)
        if len(p):
            axis[node] = p.var(0).argmax()
            place[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] >= place[node]
        held[2 * node + 1], held[2 * node + 2] = p[~right], p[right]
    return axis, place


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Neighbours:
    """Vote of the ``k`` nearest training samples; the smallest label wins ties, of distances as of votes.

    ``points`` has (x array<double>, y int), a row a sample; ``most`` of them, about, make a cell. ``transform`` reads (recording_id, i, vector), one row a sample.
    """

    def __init__(self, scaler: PipelineModel, points: DataFrame, k: int, most: int):
        self.scaler, self.k = scaler, k
        count = points.count()
        depth = max(0, math.ceil(math.log2(count / most)))
        self.points = points.withColumn("cell", F.lit(0))
        if depth:
            share = min(1.0, CUT_POINTS * 2**depth / count)
            some = points.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)) < share * (1 << 20)).select("x").collect()
            width = len(points.first()["x"])
            axis, place = _cuts(np.array([r["x"] for r in some]).reshape(-1, width), depth)

            @F.pandas_udf("int")
            def cell(x: pd.Series) -> pd.Series:
                at, p = np.zeros(len(x), int), np.array(x.to_list()).reshape(len(x), width)
                for _ in range(depth):
                    at = 2 * at + 1 + (p[np.arange(len(p)), axis[at]] >= place[at])
                return pd.Series(at - len(axis), dtype="int32")

            self.points = points.withColumn("cell", cell("x"))
        ends = self.points.select("cell", F.posexplode("x")).groupBy("cell", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("cell", "pos").collect()
        self.cells = np.array(sorted({r["cell"] for r in ends}))
        self.low, self.high = (np.array([r[c] for r in ends]).reshape(len(self.cells), -1) for c in ("low", "high"))

    def transform(self, df: DataFrame) -> DataFrame:
        """(recording_id, i, prediction)."""
        cells, low, high = self.cells, self.low, self.high

        @F.pandas_udf("int")
        def nearest_cell(x: pd.Series) -> pd.Series:
            return pd.Series([c for a in range(0, len(x), ROWS) for c in cells[to_boxes(np.array(x.iloc[a : a + ROWS].to_list()), low, high).argmin(1)]], dtype="int32")

        asked = self.scaler.transform(df).select("recording_id", "i", vector_to_array("scaled").alias("x"))
        asked = asked.withColumn("cell", nearest_cell("x")).withColumn("bound", F.lit(math.inf)).withColumn("far", F.lit(None).cast("array<double>")).withColumn("near", F.lit(None).cast("array<int>"))
        found = self._asked(asked)
        if len(cells) > 1:
            # the first cell stands for what is found already
            found = self._asked(found.select("recording_id", "i", "x", F.posexplode("cells").alias("place", "cell"), "bound", "far", "near").selectExpr("recording_id", "i", "x", "cell", "bound", "if(place = 0, far, null) AS far", "if(place = 0, near, null) AS near"))
            pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("far", "near"))))
            found = found.groupBy("recording_id", "i").agg(F.slice(pairs, 1, self.k)["near"].alias("near"))

        @F.pandas_udf("double")
        def vote(rows: pd.Series) -> pd.Series:
            return pd.Series([float(np.bincount(r).argmax()) if len(r) else None for r in rows], dtype=float)

        return found.select("recording_id", "i", vote("near").alias("prediction"))

    def _asked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what their ``cell`` has within ``bound``, and the other cells that may have nearer points; those with something found already come back as they are."""
        k, cells, low, high, kinds = self.k, self.cells, self.low, self.high, dict(rows.dtypes)
        cores = rows.sparkSession.sparkContext.defaultParallelism
        # a cell's rows are shared out where there are fewer cells than work for all cores
        pieces = max(1, math.ceil(3 * cores / len(cells)))
        own = rows.withColumn("part", F.col("cell") * pieces + F.pmod(F.xxhash64("recording_id", "i"), F.lit(pieces)).cast("int")).withColumn("y", F.lit(None).cast("int")).withColumn("kind", F.lit(1)).drop("cell")
        given = self.points.select("x", "y", F.explode(F.sequence(F.col("cell") * pieces, F.col("cell") * pieces + pieces - 1)).alias("part")).withColumn("kind", F.lit(0))
        both = own.unionByName(given, allowMissingColumns=True).select("part", "kind", "recording_id", "i", "x", "y", "bound", "far", "near")
        schema = pa.schema([("recording_id", pa.int64()), ("i", pa.int64()), ("x", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())), ("bound", pa.float64()), ("far", pa.list_(pa.float64())), ("near", pa.list_(pa.int32()))])

        def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(values, kind))

        def answered(b: pa.RecordBatch, leaves: Leaves, cell: int) -> pa.RecordBatch:
            x, bound = _rows(b.column("x")), b.column("bound").to_numpy(zero_copy_only=False)
            far, near = leaves.nearest(x, bound, k)
            count = (near >= 0).sum(1)
            limit = np.minimum(bound, far[:, -1])
            other = (to_boxes(x, low, high) <= limit[:, None]) & (cells != cell)
            # the cell itself comes first
            at, c = np.nonzero(other)
            more = np.insert(cells[c], np.searchsorted(at, np.arange(len(x))), cell)
            columns = [b.column("recording_id"), b.column("i"), b.column("x"), lists(more, other.sum(1) + 1, pa.int32()), pa.array(limit), lists(far[near >= 0], count, pa.float64()), lists(near[near >= 0], count, pa.int32())]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, schema, strict=True)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, leaves = None, [], None
            for b in batches:
                part, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "kind"))
                edge = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(kind) != 0))) if len(part) else []
                for a, z in zip(edge, [*edge[1:], len(part)], strict=True):
                    if part[a] != now:
                        now, held, leaves = part[a], [], None
                    if kind[a] == 0:
                        c = b.slice(a, z - a)
                        held.append((_rows(c.column("x")), c.column("y").to_numpy(zero_copy_only=False)))
                        continue
                    if leaves is None:
                        points, labels = map(np.concatenate, zip(*held, strict=True))
                        held, leaves = [], Leaves(points, labels)
                    for s in range(a, z, ROWS):
                        c = b.slice(s, min(ROWS, z - s))
                        known = c.column("far").is_valid()
                        if known.true_count:
                            old = c.filter(known)
                            yield pa.RecordBatch.from_arrays([old.column(f.name).cast(f.type) if f.name != "cells" else pa.nulls(len(old), f.type) for f in schema], schema=schema)
                            c = c.filter(pa.compute.invert(known))
                        if len(c):
                            yield answered(c, leaves, int(part[a]) // pieces)

        parted = both.repartition(min(2 * pieces * len(cells), 4096), "part").sortWithinPartitions("part", "kind")
        found = parted.mapInArrow(run, "recording_id long, i long, x array<double>, cells array<int>, bound double, far array<double>, near array<int>")
        return found.withColumn("recording_id", F.col("recording_id").cast(kinds["recording_id"])).withColumn("i", F.col("i").cast(kinds["i"]))
