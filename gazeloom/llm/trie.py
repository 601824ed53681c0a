"""Conversation prefix trie.

A node is a distinct sequence of first turns; its members are the conversations that
start with it and its owner is the smallest of them. Whoever owns a node owns all
deeper nodes of its own conversation, so each conversation owns one chain of nodes
that begins at its *first owned depth*. That depth is found by binary search: in each
round all undecided conversations look up the digest of their middle prefix among the
digests' minima. Chains hang below one another; their totals are added up from the
bottom by doubling (descendants within 1, 2, 4, … generations), and running sums along
each chain, from its end, give the nodes their subtrees.

Texts are read once: a turn is two 64-bit hashes, its length in code points and its
place; a prefix is the exclusive or of its turns' hashes with their depths. Long
conversations, popular prefixes and popular chains are spread by :mod:`.joins`.

Edge cases: turns go by number, null first, ties by the hashes of role and text; null
role or text is empty; a repeated row is a turn of its own; rows without conversation
id are left out; an empty table gives no rows, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import look_up, running
from .storage import drop, stash


def placed_turns(df: DataFrame) -> DataFrame:
    """(conv_id, k, a, b, chars): each turn's place from 1, hashes and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(s), role, text).alias(c) for s, c in ((1, "a"), (2, "b"))]
    small = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", *hashes, F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("k"))
    return running(small, "conv_id", ["turn", "a", "b"], sums=["k"], name="places").drop("turn")


def forked(placed: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings, as branches of a dialogue do.

    Conversation c becomes the first h turns of conversation c - c % ``group`` (all if
    fewer, none if absent) and its own turns after its first h, with
    h = crc32(c) % (``most`` + 1). Returns the turns (conv_id, d, a, b, chars) and the
    conversations (conv_id, n), also those without turns.
    """
    per = placed.groupBy("conv_id").agg(F.max("k").alias("own"))
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = per.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), cut.cast("int").alias("h"))
    turn = F.struct("k", "a", "b", "chars")
    heads = placed.where((F.col("conv_id") % group == 0) & (F.col("k") <= most)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    none = F.array().cast("array<struct<k:bigint,a:bigint,b:bigint,chars:bigint>>")
    convs = convs.join(heads, "base", "left").select("conv_id", "own", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head"))
    convs = stash(convs.select("*", F.size("head").cast("long").alias("m")), "forks")
    lent = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.k").alias("d"), "t.a", "t.b", "t.chars")
    joined = look_up(placed, convs.select("conv_id", "h", "m", "own"), ["conv_id"], "own", placed.count())
    kept = joined.where("k > h").select("conv_id", (F.col("m") + F.col("k") - F.col("h")).alias("d"), "a", "b", "chars")
    return lent.unionByName(kept), convs.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, x, y, chars): the digest of each conversation's first d turns, and its last turn's length."""
    mixed = turns.select("conv_id", "d", *[F.xxhash64(F.lit(s), "d", "a", "b").alias(c) for s, c in ((1, "x"), (2, "y"))], "chars")
    return running(mixed, "conv_id", ["d"], xors=["x", "y"], name="prefixes")


def first_owned(convs: DataFrame, rolled: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, n, first, below): where each conversation's chain begins (n + 1: nowhere) and who owns the prefix before it (null at depth 1).

    Binary search over depths 1 to n + 1: a conversation is the owner of all its prefixes from some depth on.
    """
    total = rolled.count()
    state = convs.select("conv_id", "n", F.lit(1).cast("long").alias("lo"), (F.col("n") + 1).alias("hi"), F.lit(None).cast("long").alias("below"))
    settled = [state.where("lo >= hi")]
    state = state.where("lo < hi")
    while not state.isEmpty():
        asked = state.withColumn("d", F.expr("(lo + hi) div 2")).join(rolled.select("conv_id", "d", "x", "y"), ["conv_id", "d"])
        told = look_up(asked, minima.select("d", "x", "y", "owner", "n_convs"), ["d", "x", "y"], "n_convs", total)
        owns = F.col("owner") == F.col("conv_id")
        lo, hi, below = F.when(owns, F.col("lo")).otherwise(F.col("d") + 1), F.when(owns, F.col("d")).otherwise(F.col("hi")), F.when(owns, F.col("below")).otherwise(F.col("owner"))
        after = stash(told.select("conv_id", "n", lo.alias("lo"), hi.alias("hi"), below.alias("below")), "search")
        settled.append(after.where("lo >= hi"))
        state = after.where("lo < hi")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("conv_id", "n", F.col("lo").alias("first"), "below")


def subtree_sums(values: DataFrame, parents: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(id, *sums) of ``values`` with all descendants added; ``parents`` has (id, parent), without roots.

    After round i each id holds its descendants within 2^i - 1 generations and links to its
    ancestor 2^i generations up, so rounds follow the logarithm of the height.
    """
    links = stash(parents.select("id", F.col("parent").alias("up")), "links")
    while (left := links.count()) > 0:
        more = links.join(values, "id").groupBy("up").agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]
        values = stash(values.join(more.withColumnRenamed("up", "id"), "id", "left").select("id", *added), "sums")
        weights = links.groupBy("up").agg(F.count("*").alias("weight"))
        table = links.select(F.col("id").alias("up"), F.col("up").alias("next")).join(weights, "up")
        before, links = links, stash(look_up(links, table, ["up"], "weight", left).select("id", F.col("next").alias("up")), "links")
        drop(before)
    return values


def list_digests(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """(keys, sha256): digest of the ascending decimal ``number`` of each key's rows, joined by commas.

    Rows are dealt out by ranges, each task joins what lies side by side, and only these
    pieces (a row per batch and key) meet in the task that runs the key's digest.
    """
    keys = list(keys)
    kinds = [df.schema[k] for k in keys]
    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in kinds)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in ids], axis=0)))
            texts = pc.cast(batch.column(number), pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, n), pa.int32()), texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(cuts)) for k in keys], batch.column(number).take(pa.array(cuts)), pc.binary_join(lists, ",")], names=[*keys, "least", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running_hash = None, None
        for batch in batches:
            done = []
            for *key, piece in zip(*[batch.column(k).to_pylist() for k in keys], batch.column("piece").to_pylist(), strict=True):
                if key == now:
                    running_hash.update(b"," + piece.encode())
                    continue
                if now is not None:
                    done.append([*now, running_hash.hexdigest()])
                now, running_hash = key, hashlib.sha256(piece.encode())
            yield _rows(done)
        if now is not None:
            yield _rows([[*now, running_hash.hexdigest()]])

    def _rows(done: list[list]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*keys, "sha256"])

    ranged = df.select(*keys, number).repartitionByRange(*keys, number).sortWithinPartitions(*keys, number)
    joined = ranged.mapInArrow(pieces, f"{schema}, least bigint, piece string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "least").mapInArrow(digest, f"{schema}, sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, from the turns (conv_id, d, a, b, chars) and conversations (conv_id, n): conv_id (owner), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that members share with the owner, in the subtree),
    ends_sha256 (members that end here)."""
    rolled = prefixes(turns)
    minima = stash(rolled.groupBy("d", "x", "y").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "minima")
    whole = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    root, members = whole["root"], whole["n"]
    found = stash(first_owned(convs, rolled, minima), "owned")
    is_root = F.col("conv_id") == root
    below = F.coalesce("below", F.lit(root).cast("long"))
    ends = found.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(below).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))

    # chains: the root's begins at depth 0
    chains = found.where((F.col("first") <= F.col("n")) | is_root)
    chains = chains.select("conv_id", F.when(is_root, 0).otherwise(F.col("first")).cast("long").alias("first"), F.when(~is_root, below).alias("parent"), "n")
    top = convs.sparkSession.createDataFrame([(root, 0, members, 0)] if members else [], "conv_id long, depth long, n_convs long, chars long")
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "n_convs", "chars").unionByName(top)
    saved = (F.col("n_convs") - 1) * F.col("chars")
    forks = chains.where("parent IS NOT NULL").groupBy("parent", (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("forks"))
    own = nodes.groupBy("conv_id").agg(F.sum(saved).alias("saved"))
    bottom = forks.select(F.col("parent").alias("conv_id"), F.col("depth").alias("n"), F.lit(0).cast("long").alias("leaves"))
    values = chains.join(own, "conv_id").join(bottom, ["conv_id", "n"], "left").select(F.col("conv_id").alias("id"), "saved", F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"))
    linked = chains.where("parent IS NOT NULL")
    sums = subtree_sums(stash(values, "chains"), linked.select(F.col("conv_id").alias("id"), "parent"), ["saved", "leaves"])

    hung = linked.join(sums, linked["conv_id"] == sums["id"]).groupBy(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hung = hung.agg(F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"), F.count("*").alias("forks"))
    lengths = chains.select("conv_id", "first", "parent", "n", (F.col("n") - F.col("first") + 1).alias("length"))
    along = look_up(nodes, lengths, ["conv_id"], "length", minima.count() + 1).join(hung, ["conv_id", "depth"], "left")
    zero = F.lit(0).cast("long")
    forked_here, goes_on = F.coalesce("forks", zero), (F.col("depth") < F.col("n")).cast("long")
    along = along.select(
        "conv_id",
        (-F.col("depth")).alias("up"),
        F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (goes_on + forked_here).alias("n_children"),
        (F.coalesce("hung_leaves", zero) + (goes_on + forked_here == 0).cast("long")).alias("n_leaves"),
        (saved + F.coalesce("hung_saved", zero)).alias("saved_tokens"),
    )
    summed = running(along, "conv_id", ["up"], sums=["n_leaves", "saved_tokens"], name="nodes").withColumn("depth", -F.col("up"))
    digests = list_digests(ends, ["conv_id", "depth"], "member").withColumnRenamed("sha256", "ends_sha256")
    out = summed.join(digests, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: For DuckDB, with prefixes as nested digests and crc32 from its polynomial.
ORACLE = r"""
WITH RECURSIVE crc_rows(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_rows WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS cells FROM crc_rows WHERE k = 8
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, cells[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed), crc_table
), lent AS (
  SELECT c.conv_id, p.k AS d, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base WHERE p.k <= c.h
), shares AS (SELECT c.conv_id, h, count(l.d) AS m FROM convs c LEFT JOIN lent l ON l.conv_id = c.conv_id GROUP BY ALL
), turns AS (
  SELECT conv_id, d, role, text FROM lent UNION ALL
  SELECT p.conv_id, s.m + p.k - s.h, p.role, p.text FROM placed p JOIN shares s ON s.conv_id = p.conv_id WHERE p.k > s.h
), prefixes AS (
  SELECT conv_id, d, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS p FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), ends AS (SELECT conv_id, max(d) AS n FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT d, p, min(conv_id) AS owner, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY d, p
), owned AS (
  SELECT n.owner, n.d, n.p, n.n_convs, (n.n_convs - 1) * n.chars AS saved, u.owner AS parent FROM nodes n
  LEFT JOIN prefixes q ON q.conv_id = n.owner AND q.d = n.d - 1 LEFT JOIN nodes u ON u.d = q.d AND u.p = q.p
), children AS (SELECT parent, d - 1 AS d, count(*) AS n FROM owned WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT a.d, a.p, sum(o.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM owned o JOIN prefixes a ON a.conv_id = o.owner AND a.d <= o.d LEFT JOIN children c ON c.parent = o.owner AND c.d = o.d GROUP BY a.d, a.p
), stops AS (
  SELECT p.d, p.p, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS sha FROM prefixes p JOIN ends e ON e.conv_id = p.conv_id AND e.n = p.d GROUP BY p.d, p.p
)
SELECT o.owner AS conv_id, CAST(o.d AS BIGINT) AS depth, o.parent AS parent_conv_id, CAST(o.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(s.sha, sha256('')) AS ends_sha256
FROM owned o JOIN below b USING (d, p) LEFT JOIN children c ON c.parent = o.owner AND c.d = o.d LEFT JOIN stops s ON s.d = o.d AND s.p = o.p
"""
