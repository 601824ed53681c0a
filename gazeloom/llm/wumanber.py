"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of the benchmark items
(shorter items are one window). Windows of one length form one search: the scan
looks at the block of two words at its end; the shift table says how far the next
possible end is, unknown blocks skip a whole window less one word. Where the shift
is zero, the block's bucket, split by the first two words, names the windows to
compare word by word.

The benchmark's size is measured first. Up to ``SHARD_BYTES`` its items travel with the
tasks; a larger one is written as files of about that size to the shared folder, and
each task of the one scan holds some ``HELD_CHARS`` of documents at a time, searches
them with one file after the other and merges what it finds. Neither the driver nor a
task ever holds more than one file's windows.

Edge cases: null and empty texts have no words and are never contaminated; items
without words have no window; repeated items are all reported; item ids are
compared as strings; words of an item without id count as hit, but it is not in the
list; repeated document rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, text_of
from .storage import new_dir

WINDOW = 13
#: Benchmark text whose windows a task holds, and document bytes that it searches with one file after the other.
SHARD_BYTES, HELD_CHARS = 4_000_000, 32_000_000

#: Bytes outside words become blanks, A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and all characters beyond ASCII."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class WuManber:
    """Windows of one length over word numbers; ``find`` yields (end, window number)."""

    def __init__(self, length: int, windows: list[tuple[int, ...]]):
        self.length, self.windows = length, windows
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for number, window in enumerate(windows):
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), length - end)
            self.bucket.setdefault(window[-self.block :], {}).setdefault(window[: self.block], []).append(number)

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        length, block, skip, shift = self.length, self.block, self.skip, self.shift.get
        at, n = length, len(ids)
        pairs = block == 2
        while at <= n:
            key = (ids[at - 2], ids[at - 1]) if pairs else (ids[at - 1],)
            step = shift(key, skip)
            if step:
                at += step
                continue
            found = self.bucket[key].get(tuple(ids[at - length : at - length + block]))
            if found:
                here = tuple(ids[at - length : at])
                for number in found:
                    if self.windows[number] == here:
                        yield at, number
            at += 1


class Patterns:
    """All windows of some benchmark items, one search per window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                by_length.setdefault(length, {}).setdefault(tuple(ids[at : at + length]), set()).update(() if item is None else (item,))
        self.searches = [(WuManber(length, list(found)), list(found.values())) for length, found in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit spans [start, end) in words, and the items found."""
        number = self.vocabulary.get
        ids = [number(w, 0) for w in words]
        spans, items = [], set()
        for search, owners in self.searches:
            for end, k in search.find(ids):
                spans.append((end - search.length, end))
                items |= owners[k]
        return merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_windows(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``n_words long``, ``n_hit long``, ``spans array<struct<start,end>>`` and ``items array<string>`` (sorted). Columns of these names are replaced."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    if shards == 1:
        return _scan(df, [[(r["item"], r["body"]) for r in items.collect()]], text, window)
    folder = new_dir(df.sparkSession, "shards")
    mine = items.withColumn("shard", F.pmod(F.xxhash64("item", "body"), F.lit(shards)))
    mine.repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    return _scan(df, [f"{folder}/shard={k}" for k in range(shards)], text, window)


def _items(shard: list | str) -> list[tuple[str, str | None]]:
    """A shard's (item, text): given, or read from its folder in the shared one; a hash may leave a folder out."""
    if not isinstance(shard, str):
        return shard
    fs, path = pafs.FileSystem.from_uri(shard)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    table = pq.read_table(path, columns=["item", "body"], filesystem=fs, partitioning=None)
    return list(zip(table["item"].to_pylist(), table["body"].to_pylist(), strict=True))


def _held(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together with about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.fill_null(pc.binary_length(batch.column(text)), 0)).as_py() or 0
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scan(df: DataFrame, shards: list[list | str], text: str, window: int) -> DataFrame:
    names = ["n_words", "n_hit", "spans", "items"]
    kept = [c for c in df.columns if c not in names]
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Patterns(_items(shards[0]), window) if len(shards) == 1 else None
        # with one shard each slice goes through at once
        for held in ([b] for b in slices(batches, text)) if only else _held(slices(batches, text), text, HELD_CHARS):
            found: list[list] = [[0, [], set()] for b in held for _ in range(b.num_rows)]
            for shard in shards:
                patterns = only or Patterns(_items(shard), window)
                for row, x in zip(found, (x for b in held for x in text_of(b, text)), strict=True):
                    words = words_of(x)
                    row[0] = len(words)
                    spans, items = patterns.scan(words)
                    row[1] += spans
                    row[2] |= items
                del patterns
            at = 0
            for batch in held:
                rows = []
                for n, spans, items in found[at : at + batch.num_rows]:
                    spans = merge_spans(spans)
                    rows.append((n, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(items)))
                at += batch.num_rows
                out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), span, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, names=kept + names)

    return df.mapInArrow(run, schema)


def contaminated() -> Column:
    """The rule on the columns of :func:`find_windows`: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
