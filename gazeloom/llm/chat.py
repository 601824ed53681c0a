"""Chat formatting after cumulative-snapshot collapse.

Logged conversations often hold the same dialogue at several lengths. The hash of a
conversation's first ``k`` turns rolls along: each turn adds, by exclusive or, two
64-bit hashes of its place, role and text. A conversation whose whole hash is the
hash of a proper prefix of another one is dropped with an anti-join; of equal ones
the smallest id stays. The rest is rendered with role markers.

Both sides of the anti-join are reduced to distinct hashes first, so a dialogue that
was logged millions of times is one row there. Edge cases: repeated rows of a turn
count once; turns are put in order by number, then role and text; a null role is
``user``, a null text the empty text; rows without conversation id are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stash

DEFAULT_ROLE = "user"


def turns(df: DataFrame) -> DataFrame:
    """Cleaned turns with their place ``k`` and the rolling hashes ``h1``, ``h2`` of the prefix that ends there."""
    clean = df.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = clean.withColumn("k", F.row_number().over(order).cast("long"))
    return placed.withColumns({f"h{s}": F.bit_xor(F.xxhash64(F.lit(s), "k", "role", "text")).over(rolling) for s in (1, 2)})


def maximal(placed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no longer one starts with; the smallest id of equal ones.

    ``placed`` needs conv_id, k, h1, h2 (a stashed result of :func:`turns`).
    """
    last = placed.groupBy("conv_id").agg(F.max("k").alias("n"), F.max_by(F.struct("h1", "h2"), "k").alias("h"))
    whole = last.select("n", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), "conv_id").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    shorter = placed.join(last.select("conv_id", "n"), "conv_id").where("k < n").select(F.col("k").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn between markers."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def collapse(df: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, rendered."""
    placed = stash(turns(df), "turns")
    kept = maximal(placed.select("conv_id", "k", "h1", "h2"))
    rows = placed.select("conv_id", "k", render(F.col("role"), F.col("text")).alias("part")).join(kept, "conv_id")
    joined = rows.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return joined.select("conv_id", "n_turns", F.array_join("parts.part", "").alias("rendered"))


ORACLE = r"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT conv_id, row_number() OVER w AS k, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), whole AS (
  SELECT conv_id, max(k) AS n, arg_max(prefix, k) AS rendered FROM parts GROUP BY conv_id
), firsts AS (
  SELECT min(conv_id) AS conv_id, n, rendered FROM whole GROUP BY n, rendered
), proper AS (
  SELECT DISTINCT p.k, p.prefix FROM parts p JOIN whole w ON p.conv_id = w.conv_id WHERE p.k < w.n
)
SELECT f.conv_id, CAST(f.n AS BIGINT) AS n_turns, f.rendered FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.k = f.n AND p.prefix = f.rendered)
"""
