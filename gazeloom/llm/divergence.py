"""Source divergence audit: which sources of a language use words unlike the rest.

Terms are runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased. Each
language keeps the terms of at least ``MIN_DOCS`` of its documents. A term's share in a
source is smoothed and scaled to whole numbers (``SCALE``), so all arithmetic is exact,
and two shares p and q differ by floor((p - q)^2 / (p + q)).

Many terms have the very same counts in all sources. Terms are grouped by a digest of
their sparse count column, every pair of sources is compared once per distinct column,
and the difference is multiplied by the column's number of terms. Pairs are dealt out
as cells, a block of sources against a block of sources and a share of the columns; a
task runs through a cell's columns in order and keeps one matrix of sums. What a column
without counts in either source would add is counted, not computed. Terms are ranked
on their own counts.

Edge cases: null text, language or source is the empty one; a group without terms takes
part with zero counts; a language whose terms are all rare compares its sources as 0 and
has no term rows; of a language with one source there are no pairs; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .joins import look_up
from .storage import drop, stash

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Sources in a block, and shares of the columns, of a cell.
BLOCK, SHARES = 64, 64
#: Rows of a cell that are compared at a time, and terms counted in a task before they are passed on.
ROWS, HELD = 8192, 400_000
#: Letters of ASCII in lower case and all bytes beyond; everything else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (k, s), (n, docs) in seen.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    columns = [pa.array([k] * len(part), pa.string()), pa.array([s] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[x] for x in part], pa.int64()), pa.array([docs[x] for x in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in slices(batches, "text"):
            for k, s, x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, docs = seen.setdefault((k, s), (Counter(), Counter()))
                words = x.translate(_TERMS).split()
                n.update(words)
                docs.update(set(words))
            if sum(len(n) for n, _ in seen.values()) >= HELD:
                yield from flush()
        yield from flush()

    plain = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_of(n: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 * kept)) without overflow; 1 if nothing is kept."""
    above = F.lit(scale).cast("decimal(19,0)") * (n + 2).cast("decimal(19,0)")
    return 1 + F.coalesce(F.call_function("div", above, F.nullif((total + 2 * kept).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))), F.lit(0).cast("long"))


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Cell:
    """Sums of one cell: sources ``rows`` (index, name, share of a term that it lacks) of two blocks."""

    def __init__(self, lang: str, own: int, other: int, first_share: bool, kept: int, block: int, rows_at_once: int):
        self.block, self.rows_at_once = block, rows_at_once
        self.lang, self.own, self.other, self.extra = lang, own, other, kept if first_share else 0
        self.sources: tuple[dict[int, tuple[str, int]], ...] = ({}, {})
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.n_pending = 0
        self.sums: np.ndarray | None = None

    def source(self, index: int, name: str, least: int) -> None:
        for side, block in enumerate((self.own, self.other)):
            if index // self.block == block:
                self.sources[side][index] = (name, least)

    def _least(self, side: int) -> np.ndarray:
        out = np.ones(self.block, np.int64)
        for index, (_, least) in self.sources[side].items():
            out[index % self.block] = least
        return out[: max((i % self.block for i in self.sources[side]), default=-1) + 1]

    @staticmethod
    def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def add(self, column: np.ndarray, index: np.ndarray, share: np.ndarray, terms: np.ndarray) -> None:
        """Counts of columns, numbered in ascending order; a column may go on in the next call."""
        self.pending.append((column, index, share, terms))
        self.n_pending += len(column)
        if self.n_pending >= self.rows_at_once:
            self.compare(ends=False)

    def compare(self, ends: bool) -> None:
        """Compare the pending columns, but for the last one unless the cell ends."""
        if not self.pending:
            return
        column, index, share, terms = (np.concatenate(x) for x in zip(*self.pending, strict=True))
        keep = np.zeros(len(column), bool) if ends else column == column[-1]
        self.pending = [tuple(x[keep] for x in (column, index, share, terms))] if keep.any() else []
        self.n_pending = int(keep.sum())
        column, index, share, terms = (x[~keep] for x in (column, index, share, terms))
        if not len(column):
            return
        _, first, row = np.unique(column, return_index=True, return_inverse=True)
        n, least = terms[first], [self._least(s) for s in (0, 1)]
        shares = []
        for side, block in enumerate((self.own, self.other)):
            dense = np.tile(least[side], (len(first), 1))
            here = index // self.block == block
            dense[row[here], index[here] % self.block] = share[here]
            shares.append(dense)
        if self.sums is None:
            self.sums = np.zeros((len(least[0]), len(least[1])), np.int64)
        for i in range(len(least[0])):
            at = i + 1 if self.own == self.other else 0
            f = self._differ(shares[0][:, i : i + 1], shares[1][:, at:])
            self.sums[i, at:] += n @ f - n.sum() * self._differ(least[0][i], least[1][at:])

    def rows(self) -> list[tuple[str, str, str, int]]:
        self.compare(ends=True)
        out = []
        for i, (a, p) in sorted(self.sources[0].items()):
            for j, (b, q) in sorted(self.sources[1].items()):
                if i < j:
                    summed = int(self.sums[i % self.block, j % self.block]) if self.sums is not None else 0
                    out.append((self.lang, a, b, summed + self.extra * int(self._differ(p, q))))
        return out


def compare_sources(columns: DataFrame, sources: DataFrame, block: int = BLOCK, shares: int = SHARES, rows_at_once: int = ROWS) -> DataFrame:
    """(lang, a, b, value) for each two sources of a language, summed over all kept terms.

    ``columns``: (lang, column string, index, share, terms), a row for each count of each distinct column;
    ``sources``: (lang, source, index, n_sources, least, kept), ``least`` being the share of a term without counts.
    """
    own_block, last = F.floor(F.col("index") / block), F.floor((F.col("n_sources") - 1) / block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("y")
    no = F.lit(None)
    data = columns.select("lang", own_block.alias("x"), other, F.pmod(F.xxhash64("column"), F.lit(shares)).alias("part"), "column", "index", "share", "terms", no.cast("string").alias("source"), no.cast("long").alias("kept"))
    heads = sources.select("lang", own_block.alias("x"), other, "index", "least", "source", "kept").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    heads = heads.select("lang", "x", "y", "part", no.cast("string").alias("column"), "index", F.col("least").alias("share"), no.cast("long").alias("terms"), "source", "kept")
    dealt = data.unionByName(heads)
    low, high = F.least("x", "y"), F.greatest("x", "y")
    dealt = dealt.select("lang", low.alias("own"), high.alias("other"), "part", "column", "index", "share", "terms", "source", "kept")
    cell = ["lang", "own", "other", "part"]
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell, "column", "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cell | None = None
        key, last_column, number = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = pc.dictionary_encode(batch.column("lang")).indices.to_numpy(zero_copy_only=False)
            own, other, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in cell[1:])
            coded = pc.dictionary_encode(batch.column("column"))
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            names = coded.dictionary
            cuts = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (own[1:] != own[:-1]) | (other[1:] != other[:-1]) | (part[1:] != part[:-1])))
            index = batch.column("index").to_numpy(zero_copy_only=False)
            share = batch.column("share").to_numpy(zero_copy_only=False)
            terms = pc.fill_null(batch.column("terms"), 0).to_numpy(zero_copy_only=False)
            done = []
            for at, to in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                here = (batch.column("lang")[int(at)].as_py(), int(own[at]), int(other[at]), int(part[at]))
                if here != key:
                    if now is not None:
                        done += now.rows()
                    key, last_column, number = here, None, 0
                    now = _Cell(here[0], here[1], here[2], here[3] == 0, batch.column("kept")[int(at)].as_py(), block, rows_at_once)
                heads = int(np.searchsorted(code[at:to] >= 0, True))
                for i in range(at, at + heads):
                    now.source(int(index[i]), batch.column("source")[int(i)].as_py(), int(share[i]))
                at += heads
                if at == to:
                    continue
                column = code[at:to]
                starts = np.append(names[int(column[0])].as_py() != last_column, column[1:] != column[:-1])
                numbers = number + np.cumsum(starts)
                number, last_column = int(numbers[-1]), names[int(column[-1])].as_py()
                now.add(numbers, index[at:to], share[at:to], terms[at:to])
            yield _batch(done)
        if now is not None:
            yield _batch(now.rows())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(a, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "a", "b", "value"])

    return dealt.mapInArrow(run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, shares: int = SHARES, rows_at_once: int = ROWS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` compares the source with each other one of its language, ``term``
    has the ``top`` terms that it uses more than the language does."""
    counts = stash(count_terms(df), "counts")
    digest = [F.bit_xor(F.xxhash64(F.lit(s), "source", "n")).alias(c) for s, c in ((1, "x"), (2, "y"))]
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("n_sources"), *digest).where(F.col("docs") >= min_docs).drop("docs")
    terms = stash(terms, "terms")
    # terms with one column: the least of them stands for all
    columns = terms.groupBy("lang", "x", "y", "total", "n_sources").agg(F.min("term").alias("term"), F.count("*").alias("terms")).select("lang", "term", "terms")
    marked = terms.select("lang", "term", "total").join(columns, ["lang", "term"], "left")
    kept = stash(counts.drop("docs").join(marked, ["lang", "term"]), "kept")
    drop(counts)

    per_lang = terms.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("kept"))
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_total"), F.count("*").alias("weight"))
    every = df.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = every.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("source_total", "weight", "lang_total", "kept")])
    in_lang = Window.partitionBy("lang")
    groups = groups.select("*", (F.row_number().over(in_lang.orderBy("source")).cast("long") - 1).alias("index"), F.count("*").over(in_lang).alias("n_sources"))
    groups = stash(groups.withColumn("least", share_of(zero, F.col("source_total"), F.col("kept"))), "sources")

    shared = look_up(kept, groups.drop("least"), ["lang", "source"], "weight", kept.count())
    p, q = share_of(F.col("n"), F.col("source_total"), F.col("kept")), share_of(F.col("total"), F.col("lang_total"), F.col("kept"))
    compared = compare_sources(
        shared.where("terms IS NOT NULL").select("lang", F.col("term").alias("column"), "index", "n_sources", p.alias("share"), "terms"),
        groups.select("lang", "source", "index", "n_sources", "least", "kept"),
        block,
        shares,
        rows_at_once,
    )
    # each pair stands for both of its sources
    pairs = compared.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"))
    pairs = pairs.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    owned = shared.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    owned = owned.select("lang", "source", F.lit("term").alias("part"), "item", difference(F.col("p"), F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(owned.withColumn("rank", ranked).where(F.col("rank") <= top))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 10
), langs AS (SELECT d.lang, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) k ON k.lang = d.lang
), groups AS (
  SELECT d.lang, d.source, v, l.total AS lang_total, coalesce(c.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d JOIN langs l ON l.lang = d.lang
  LEFT JOIN (SELECT w.lang, w.source, count(*) AS total FROM words w JOIN kept USING (lang, term) GROUP BY ALL) c ON c.lang = d.lang AND c.source = d.source
), counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST((1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS BIGINT) AS p,
    1 + CAST((1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
