"""Language ID with a bit-sliced Bloom filter over character n-grams.

Row ``r`` of the filter is a bit mask with one bit per language (several 64-bit masks,
where there are more labels). An n-gram hashes
to ``HASHES`` rows; the AND of these masks has the bit of every language whose
n-gram set holds it (and some by chance). A text's score for a language is the
number of its n-grams with that bit, less the hits that the filter's false-positive
rate for the language explains. The language with the highest corrected count wins.

Fitting: n-gram counts come from a bounded sample of labelled rows
(``docs_per_language`` expected rows per language, chosen by a hash of the id);
each language keeps its ``grams_per_language`` most frequent n-grams, so the
filter has a fixed size however large the corpus is. Prediction reads whole texts.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text
whose letters match no language goes to the first language in order with score 0;
ties go to the first language in order; without labelled rows everything is ``und``;
an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, text_of

ORDERS = (2, 3, 4)
HASHES = 3
#: Rows of the filter (a power of two).
ROWS = 1 << 20
DOCS_PER_LANGUAGE = 1500
GRAMS_PER_LANGUAGE = 20_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def letter_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one blank for each run of others, as code points; the text each belongs to; letters per text."""
    lowered = [x.lower() for x in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    letter = _letters()[points]
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    before = np.append(True, letter[:-1] | (owner[1:] != owner[:-1])) if len(points) else letter
    keep = letter | before
    return np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep], n_letters


def gram_hashes(points: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams that lie inside one text, and their texts."""
    if len(points) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(points) - order + 1
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint64(0x100000001B3) + np.uint64(0x632BE59BD9B4E019)
    inside = owner[:n] == owner[order - 1 :]
    return _mix(h[inside]), owner[:n][inside]


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): occurrences of hashed n-grams per language, summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            by: dict[str, list[str]] = {}
            for k, x in zip(batch.column(lang).to_pylist(), text_of(batch, text), strict=True):
                by.setdefault(k, []).append(x)
            for k, texts in by.items():
                points, owner, _ = letter_stream(texts)
                grams, n = np.unique(np.concatenate([gram_hashes(points, owner, o)[0] for o in ORDERS]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return df.select(lang, text).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class BitSlicedFilter:
    """The fitted filter: ``planes[r]`` holds the language bits of row ``r``."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        # a mask of the smallest kind, or several of 64 bits
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(k).itemsize), np.uint64)
        self.bits = 8 * np.dtype(kind).itemsize
        self.planes = np.zeros((-(-len(languages) // self.bits), ROWS), kind)
        filled = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            word, bit = divmod(k, self.bits)
            for rows in self.rows_of(grams[lang]):
                self.planes[word][rows] |= kind(1 << bit)
            filled[k] = np.count_nonzero(self.planes[word] & kind(1 << bit)) / ROWS
        self.false_rate = filled**HASHES

    @staticmethod
    def rows_of(grams: np.ndarray) -> list[np.ndarray]:
        step = (grams >> np.uint64(40)) | np.uint64(1)
        return [((grams + np.uint64(k) * step) & np.uint64(ROWS - 1)).astype(np.intp) for k in range(HASHES)]

    def masks(self, rows_of_grams: list[np.ndarray], word: int) -> np.ndarray:
        """All languages of a mask word that hold each n-gram: the AND of its rows."""
        first, *rest = rows_of_grams
        plane = self.planes[word]
        out = plane[first]
        for rows in rest:
            out = out & plane[rows]
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hit counts (texts x languages) and letters per text."""
        points, owner, letters = letter_stream(texts)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        one = self.planes.dtype.type(1)
        for order in ORDERS:
            grams, of = gram_hashes(points, owner, order)
            rows = self.rows_of(grams)
            total += np.bincount(of, minlength=len(texts))
            for word in range(len(self.planes)):
                masks = self.masks(rows, word)
                for k in range(word * self.bits, min((word + 1) * self.bits, len(self.languages))):
                    hits[:, k] += np.bincount(of, (masks >> self.planes.dtype.type(k % self.bits)) & one, len(texts))
        return np.maximum(0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate)), letters


def fit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE) -> BitSlicedFilter:
    """Fit on labelled rows; what reaches the driver has at most languages x ``grams_per_language`` rows."""
    labelled = df.where(F.col(lang).isNotNull())
    n_of = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not n_of:
        return BitSlicedFilter([], {})
    # the share of each language's rows that is read; a hash of the id decides, so retries read the same rows
    share = F.create_map(*[F.lit(x) for k, n in n_of.items() for x in (k, min(1.0, docs_per_language / n))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = count_grams(chosen, text, lang).withColumn("rank", rank).where(F.col("rank") <= grams_per_language).select("lang", "gram").toPandas()
    languages = sorted(n_of)
    return BitSlicedFilter(languages, {k: top.gram[top.lang == k].to_numpy(np.int64).view(np.uint64) for k in languages})


def predict(df: DataFrame, model: BitSlicedFilter, text: str = "text") -> DataFrame:
    """Add ``lang_pred string`` and ``score double``: the winner's share of all corrected hits. Columns of these names are replaced."""
    names = ["lang_pred", "score"]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if model.languages:
                hits, letters = model.scores(text_of(batch, text))
                best, sums = hits.argmax(1), hits.sum(1)
                known = letters > 0
                score = np.where(known & (sums > 0), hits.max(1) / np.maximum(sums, 1e-300), 0.0)
                lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            else:
                lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=kept + names)

    return df.mapInArrow(run, schema)
