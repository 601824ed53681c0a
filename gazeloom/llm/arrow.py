"""Helpers for Arrow-batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters handled at a time inside a batch; bounds a Python worker's memory.
CHUNK_CHARS = 250_000


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in each piece hold about ``limit`` bytes.

    A single longer string is a piece of its own and stays whole.
    """
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def text_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
