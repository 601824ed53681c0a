"""Media columns: chroma audio fingerprints and their alignment.

A recording (mono 16-bit PCM) becomes frames of 12 pitch-class energies. Sixteen
filters, each a contrast of two rectangles in the pitch-class by time plane, are read
off the frames' integral image at every time step; each contrast is quantised to two
Gray-coded bits, together a packed 32-bit integer. Two recordings are aligned by
looking up pairs of integers ``GAP`` steps apart and voting in a histogram of offsets;
where some offset has ``MIN_VOTES`` votes, bit errors are counted at all offsets by
correlations of the bits. Steps that hold one tone are looked up as one run.

Recordings with equal fingerprints form a class and only classes are looked up, so a
recording that was stored millions of times is one row there. Edge cases: null,
empty and too short recordings have an empty fingerprint, form no class with others
and align with nothing (those without id are one class); an odd last byte is ignored;
silence has zero contrasts; repeated rows get a row each; an empty table gives no rows;
columns other than id and recording are not passed on. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stash

RATE = 2048
WINDOW, HOP = 512, 128
LOW_HZ, HIGH_HZ = 110.0, 900.0
#: (kind, first pitch class, pitch classes, steps): kinds halve a rectangle in time, in pitch, or in quarters.
FILTERS = [(k % 3, (5 * k) % 12, 2 + 2 * (k % 3), 4 + 4 * (k % 4)) for k in range(16)]
SPAN = max(f[3] for f in FILTERS)
CUTS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint64)
GAP = 4
#: Tasks that the recordings with a key are dealt to.
SALTS = 8
#: Votes for an offset, overlapping steps, and share of wrong bits of an alignment.
MIN_VOTES, MIN_OVERLAP, MAX_ERROR = 4, 24, 0.25


def chroma_frames(pcm: bytes | None) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame scaled to length one."""
    x = np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], "<i2").astype(np.float32)
    n = (len(x) - WINDOW) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    framed = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP] * np.hanning(WINDOW).astype(np.float32)
    power = np.abs(np.fft.rfft(framed, axis=1)) ** 2
    hz = np.fft.rfftfreq(WINDOW, 1 / RATE)
    used = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(hz[used] / 440.0)).astype(int) % 12
    out = np.zeros((n, 12))
    for k in range(12):
        out[:, k] = power[:, used][:, pitch == k].sum(1)
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """Packed 32-bit integers, one per time step with a full filter span."""
    frames = chroma_frames(pcm)
    steps = len(frames) - SPAN + 1
    if steps < 1:
        return np.zeros(0, np.int64)
    # pitch classes wrap around: the image holds them twice
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([frames, frames], 1), 0), 1)
    t = np.arange(steps)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t + t1, p1] - image[t + t0, p1] - image[t + t1, p0] + image[t + t0, p0]

    codes = np.zeros(steps, np.uint64)
    for kind, p, high, wide in FILTERS:
        half_t, half_p = wide // 2, high // 2
        if kind == 0:
            a, b = area(0, half_t, p, p + high), area(half_t, wide, p, p + high)
        elif kind == 1:
            a, b = area(0, wide, p, p + half_p), area(0, wide, p + half_p, p + high)
        else:
            a = area(0, half_t, p, p + half_p) + area(half_t, wide, p + half_p, p + high)
            b = area(0, half_t, p + half_p, p + high) + area(half_t, wide, p, p + half_p)
        contrast = np.log1p(a) - np.log1p(b)
        codes = (codes << np.uint64(2)) | GRAY[np.searchsorted(CUTS, contrast, "right")]
    return codes.astype(np.int64)


def add_fingerprints(df: DataFrame, id_col: str, pcm: str) -> DataFrame:
    """(id, codes array<long>): the fingerprints of a binary PCM column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = [fingerprint(x.as_py()) for x in part.column(pcm)]
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=["id", "codes"])

    return df.select(id_col, pcm).mapInArrow(run, "id long, codes array<long>")


def sonify(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, pcm binary): each number of a vector as a tone of an eighth of a second, its pitch by size. Null vectors give null."""
    steps = RATE // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(steps) / RATE
        tones = np.stack([np.sin(2 * np.pi * 220.0 * 2 ** (k / 12) * time) for k in range(24)])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pcm = []
                for row in part.column(vector):
                    v = np.array([0.0 if x is None or x != x else x for x in row.as_py()]) if row.is_valid else None
                    pcm.append(None if v is None else (tones[np.clip(np.floor(12 + 60 * v), 0, 23).astype(int)].ravel() * 12000).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(pcm, pa.binary())], names=["id", "pcm"])

    return df.select(id_col, vector).mapInArrow(run, "id long, pcm binary")


def _keys(classes: DataFrame, who: str, prefix: str) -> DataFrame:
    """Runs of equal pairs of codes ``GAP`` steps apart: key, step where the run starts, its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes = batch.column("codes")[k].values.to_numpy(zero_copy_only=False)
                key = codes[:-GAP] << 32 | codes[GAP:]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(at, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("class_id")[k].as_py(), np.int64)), pa.array(key[at]), pa.array(at), pa.array(size)], names=[who, "key", f"{prefix}t", f"{prefix}n"])

    # classes without id have no fingerprint
    coded = classes.where((F.size("codes") > GAP) & F.col("class_id").isNotNull()).select("class_id", "codes")
    return coded.mapInArrow(run, f"{who} long, key long, {prefix}t long, {prefix}n long")


def offset_votes(asked: DataFrame, every: DataFrame) -> DataFrame:
    """(q, r, votes): the highest bar of each pair's histogram of offsets.

    Two runs of one key, n and m steps long, vote for n + m - 1 offsets by a trapezoid. Its
    second difference has four entries, so a tone held for an hour is as cheap as a step;
    the histogram's height at an offset is the sum of all entries before it, each times its distance.
    """
    runs = asked.join(every, ["key", "salt"]).where("q <> r")
    first = F.col("rt") - F.col("qt") - F.col("qn") + 1
    entries = F.array(*[F.struct((first + ahead).alias("o"), F.lit(w).cast("long").alias("w")) for ahead, w in ((F.lit(0), 1), (F.col("qn"), -1), (F.col("rn"), -1), (F.col("qn") + F.col("rn"), 1))])
    bends = runs.select("q", "r", F.explode(entries).alias("e")).groupBy("q", "r", F.col("e.o").alias("o")).agg(F.sum("e.w").alias("w"))
    in_order = Window.partitionBy("q", "r").orderBy("o")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    lines = bends.select("q", "r", "o", F.lead("o").over(in_order).alias("next"), F.sum("w").over(so_far).alias("slope"), F.sum(F.col("w") * (1 - F.col("o"))).over(so_far).alias("level"))
    # between two bends the height is a line, so its ends tell
    height = F.greatest(F.col("slope") * F.col("o") + F.col("level"), F.col("slope") * (F.coalesce("next", F.col("o") + 1) - 1) + F.col("level"))
    return lines.groupBy("q", "r").agg(F.max(height).alias("votes"))


def bit_errors(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wrong bits of ``x`` against ``y`` at all offsets from 1 - len(x) to len(y) - 1, and the steps that overlap."""
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    same = np.zeros(n)
    for bit in range(32):
        a, b = (((v >> bit) & 1) * 2.0 - 1 for v in (x, y))
        same += np.fft.irfft(np.fft.rfft(b, size) * np.fft.rfft(a[::-1], size), size)[:n]
    offset = np.arange(1 - len(x), len(y))
    over = np.minimum(len(x), len(y) - offset) - np.maximum(0, -offset)
    return np.rint((32 * over - same) / 2).astype(np.int64), over


def best_offset(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
    """The offset with the smallest share of wrong bits among those with ``MIN_OVERLAP`` steps (the first at a tie), and that share; none where it is above ``MAX_ERROR``."""
    if not len(x) or not len(y):
        return None
    wrong, over = bit_errors(x, y)
    share = np.where(over >= MIN_OVERLAP, wrong / (over * 32.0), np.inf)
    at = int(share.argmin())
    return (at + 1 - len(x), float(share[at])) if share[at] <= MAX_ERROR else None


def align(prints: DataFrame, queries: Column) -> DataFrame:
    """One row per recording: id, class_id, n_links, best_class, best_offset, bit_error.

    ``queries`` marks the recordings of ``prints`` (id, codes) that are looked up; the
    links of a class are the other classes with a marked member that it aligns with
    (for marked classes, all classes they align with). ``best_offset`` is the step of
    the best class at which the recording starts; ties go to the smaller class.
    """
    prints = prints.withColumn("asked", queries)
    digest = F.when(F.size("codes") > 0, F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256)).otherwise(F.concat(F.lit("id "), F.coalesce(F.col("id").cast("string"), F.lit("none"))))
    prints = stash(prints.withColumn("digest", digest), "prints")
    classes = stash(prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.max("asked").alias("asked"), F.min_by("codes", "id").alias("codes")), "classes")
    # the looked-up side is repeated, so a key that many recordings hold (silence, a jingle) is dealt over SALTS tasks
    asked = _keys(classes.where("asked"), "q", "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = _keys(classes, "r", "r").withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int"))
    pairs = stash(offset_votes(asked, every).where(F.col("votes") >= MIN_VOTES).select("q", "r"), "pairs")
    left = classes.select(F.col("class_id").alias("q"), F.col("codes").alias("x"))
    right = classes.select(F.col("class_id").alias("r"), F.col("codes").alias("y"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, r, x, y in zip(*(batch.column(c) for c in ("q", "r", "x", "y")), strict=True):
                found = best_offset(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False))
                if found:
                    rows.append((q.as_py(), r.as_py(), found[1], found[0]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["q", "r", "error", "offset"])

    links = pairs.join(left, "q").join(right, "r").select("q", "r", "x", "y").mapInArrow(score, "q long, r long, error double, offset long")
    links = stash(links, "links")
    drop(pairs)
    both = links.unionAll(links.select(F.col("r").alias("q"), F.col("q").alias("r"), "error", (-F.col("offset")).alias("offset"))).dropDuplicates(["q", "r"])
    order = F.struct("error", "r")
    of_class = both.groupBy(F.col("q").alias("class_id")).agg(F.count("*").alias("n_links"), F.min_by("r", order).alias("best_class"), F.min_by("offset", order).alias("best_offset"), F.min("error").alias("bit_error"))
    out = prints.select("id", "digest").join(classes.select("digest", "class_id"), "digest").join(of_class, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "best_class", F.col("best_offset").cast("long").alias("best_offset"), "bit_error")
