"""Joins and running totals that no single key can hold up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stash

#: Keys that at least this share of the rows ask for are hot; there are at most so many of them.
HOT_KEYS = 10_000
#: A key that fewer rows ask for is never hot.
HOT_ROWS = 1_000


def look_up(asked: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Inner (or left) join of ``asked`` with ``table``, which has each key once.

    ``weight`` is a column of ``table`` (dropped): at least as many as the rows of
    ``asked`` with this key; ``total`` at least the sum of them all. Hot keys, at most ``HOT_KEYS``
    by that sum, are broadcast; the others are shuffled, none of them with more than a
    ten-thousandth of the rows (or ``HOT_ROWS``).
    """
    least = max(HOT_ROWS, total / HOT_KEYS)
    hot, cold = table.where(F.col(weight) >= least).drop(weight), table.where(F.col(weight) < least).drop(weight)
    found, rest = asked.join(F.broadcast(hot), list(on)), asked
    if how == "left":
        rest = asked.join(F.broadcast(hot.select(*on)), list(on), "left_anti")
    return found.unionByName(rest.join(cold.hint("shuffle_merge"), list(on), how))


def running(df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = (), name: str = "running") -> DataFrame:
    """Replace long columns by their running sums or exclusive ors within ``key`` (a long without nulls), in ascending order (nulls first).

    Rows are dealt out by ranges of key and order, so a key with any number of rows fills
    many tasks. Each task runs through its range once; what a key brings along from the
    ranges before is added by a broadcast table with at most one row a range.
    """
    ops = [(c, np.add) for c in sums] + [(c, np.bitwise_xor) for c in xors]
    back = {c: (np.subtract if f is np.add else np.bitwise_xor) for c, f in ops}
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("range_no", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            starts = np.append(True, keys[1:] != keys[:-1])
            first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            goes_on = (first == 0) & (keys == last) if last is not None else np.zeros(n, bool)
            new = {}
            for c, f in ops:
                total = f.accumulate(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                x = back[c](total, np.append(0, total[:-1])[first])
                x[goes_on] = f(x[goes_on], carry.get(c, 0))
                new[c] = x
            last, carry = keys[-1], {c: x[-1] for c, x in new.items()}
            columns = [pa.array(new[c]) if c in new else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(done, done + n))], names=[*names, "range_no", "place"])
            done += n

    by = [key, *order]
    local = stash(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), name)
    # the last key of each range may go on in the next one
    ends = local.groupBy("range_no").agg(F.max_by(F.struct(key, *[c for c, _ in ops]), "place").alias("end")).select("range_no", "end.*")
    so_far = Window.partitionBy(key).orderBy("range_no")
    total = {c: (F.sum if f is np.add else F.bit_xor) for c, f in ops}
    brought = [total[c](c).over(so_far).alias(f"before_{c}") for c, _ in ops]
    before = ends.select(key, F.lead("range_no").over(Window.orderBy("range_no")).alias("range_no"), *brought).where("range_no IS NOT NULL")
    joined = local.join(F.broadcast(before), [key, "range_no"], "left")
    merged = {c: F.coalesce(F.col(c) + F.col(f"before_{c}"), c) if f is np.add else F.coalesce(F.col(c).bitwiseXOR(F.col(f"before_{c}")), c) for c, f in ops}
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in df.columns])
