"""Near duplicates: chosen-path set similarity join on word shingles.

1. Each document becomes a set of hashed shingles, a set digest, a sketch (one byte
   of each of ``POSITIONS`` minwise values) and one whole minwise value for each root.
   Equal sets form a class; only its first document goes on.
2. Every class joins the ``ROOTS`` nodes at the top of ``TREES`` independent trees that
   branch on ``BRANCHES`` minwise values.
3. In every node with two or more members each is compared with the node's first
   and last member. Sketches discard pairs that are far below the threshold; the
   rest is confirmed on full sets. This costs time in proportion to the node and
   already joins up large groups of copies.
4. Nodes whose members are in one component have nothing left to find. In the others
   the members outside the largest component are the *minority*. A node with a
   minority of at most ``SMALL`` members is compared exhaustively: every minority
   member with all others by sketches, the majority dealt over groups of ``BLOCK``,
   so nothing but the minority is repeated. Members with a candidate are compared
   on full sets, and links that join components come out.
5. Other nodes are branched: each member goes to ``BRANCHES`` children, by a minwise
   byte that the node picks. A node that has not become small after ``DEPTH`` levels
   (its members agree in nearly everything, and still stars have not joined them) is
   compared whole, dealt over pairs of blocks, so that no pair is dropped.
6. Components of the confirmed links give the groups.

A pair with similarity ``s`` shares no root with probability ``(1 - s) ** ROOTS``:
5.8e-9 at 0.85, 1.0e-7 at 0.80. If each of its nodes must be branched, however often,
a tree loses it with the probability ``q`` that a branching process dies out,
``q = (1 - s + s * q) ** BRANCHES``, and all trees with ``q ** TREES``: 2.9e-8 at 0.85
and 9.5e-7 at 0.80. The sketches lose about 1e-6 more.

Full sets are made only for documents in a candidate pair. Nothing is collected to
the driver but counts. Edge cases: a document without words (null, empty) has an
empty set and links with nothing; one with fewer words than a shingle has its whole
sequence as its only shingle; repeated rows get a row each; a row without id takes
part through rows of the same set that have one, else its component is null and it
is kept; columns other than id and text are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, text_of
from .components import components
from .joins import look_up
from .storage import drop, stash

WORDS = 5
THRESHOLD = 80
POSITIONS = 128
TREES, BRANCHES, DEPTH = 5, 2, 8
ROOTS = TREES * BRANCHES
#: Minority of a node that is compared exhaustively, other members in one group of it, and shingles of a group of full sets.
SMALL = 2048
BLOCK = 1024
SET_ITEMS = 1 << 22
#: Standard errors below the threshold at which a sketch still passes.
SLACK = 4.7

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULTIPLIERS = _RNG.integers(1, 2**63, POSITIONS + ROOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without blank, tab, or U+000A-U+000D; A-Z lowered) in order, and the text of each."""
    coded = [x.encode().translate(_LOWER) for x in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    starts_of = np.cumsum([0] + [len(x) + 1 for x in coded])
    inner = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inner.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # sums of byte values times powers of an odd base, moved to the word's start with the inverse power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(len(raw), _BASE), dtype=np.uint64)])
    back = _powers(len(raw), pow(_BASE, -1, 2**64))
    hashes = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts_of, starts, "right") - 1


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hashes, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled = (rolled + hashes[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
    rolled = _mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            h = np.full(1, 1 + b - a, np.uint64)
            for k in range(a, b):
                h = (h + hashes[k]) * np.uint64(0xA0761D6478BD642F)
            yield _mix(h)
        else:
            yield np.zeros(0, np.uint64)


def minwise(items: np.ndarray) -> np.ndarray:
    """The high halves of the smallest hash of the set under each multiplier."""
    low = np.full(len(_MULTIPLIERS), 2**64 - 1, np.uint64)
    for at in range(0, len(items), 512):
        low = np.minimum(low, (items[at : at + 512, None] * _MULTIPLIERS).min(0))
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(df: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, n, h1, h2, sketch binary, path array<long>); the last four are null for an empty set."""
    schema = "id long, n long, h1 long, h2 long, sketch binary, path array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for items in shingle_sets(text_of(batch, text), words):
                if not len(items):
                    rows.append((0, None, None, None, None))
                    continue
                low = minwise(items)
                h1, h2 = _mix(items + np.uint64(1)).sum(dtype=np.uint64), _mix(items ^ np.uint64(_BASE)).sum(dtype=np.uint64)
                rows.append((len(items), int(h1.astype(np.int64)), int(h2.astype(np.int64)), low[:POSITIONS].astype(np.uint8).tobytes(), low[POSITIONS:].astype(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64())] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["id", "n", "h1", "h2", "sketch", "path"])

    return df.select(id_col, text).mapInArrow(run, schema)


def full_sets(df: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """(id, items array<long>) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [x.view(np.int64) for x in shingle_sets(text_of(batch, text), words)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return df.select(id_col, text).mapInArrow(run, "id long, items array<long>")


def least_agreement(threshold: int) -> int:
    """Equal sketch bytes that a pair at the threshold has but for ``SLACK`` standard errors."""
    s = threshold / 100
    return int(POSITIONS * (s - SLACK * (s * (1 - s) / POSITIONS) ** 0.5))


def _alike(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree often enough."""
    left = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    least = least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((sa == sb).sum(1) >= least))

    # sizes bound the similarity: the smaller set over the larger one
    sized = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(docs: DataFrame, pairs: DataFrame, id_col: str, text: str, words: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold; ``pairs`` is a stashed table."""
    wanted = pairs.select(F.col("a").alias(id_col)).unionAll(pairs.select(F.col("b").alias(id_col))).distinct()
    one_row = docs.select(id_col, text).join(wanted.hint("merge"), id_col, "left_semi").dropDuplicates([id_col])
    sets = stash(full_sets(one_row, id_col, text, words), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(right, "b").join(left, "a").where(both * 100 >= (F.size("x") + F.size("y") - both) * threshold)
    out = stash(found.select("a", "b"), "links")
    drop(sets)
    return out


def _in_groups(df: DataFrame, fn, out: str) -> DataFrame:
    """Apply ``fn`` to the rows of each value of ``g`` in turn, while they stream through sorted tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and g[lo] != key:
                    yield from fn(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = g[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(run, out)


def _blocks(df: DataFrame, node: str, weight, limit: int) -> DataFrame:
    """Column ``g``: the node, or where it weighs more than ``limit`` the pairs of its blocks, so that any two members meet in a group."""
    k = F.ceil(weight / (limit / 2)).cast("int")
    df = df.withColumn("k", F.when(weight > limit, k).otherwise(1)).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64(node, F.least("mine", "other"), F.greatest("mine", "other"))
    return df.withColumn("g", F.when(F.col("k") > 1, pair).otherwise(F.col(node))).drop("k", "mine", "other")


def _spread(df: DataFrame) -> DataFrame:
    """Columns ``g``, ``home``, ``major`` for nodes of a small minority: members of the largest component are dealt over blocks, the others go to every block and are at home in one."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    df = df.withColumn("k", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("major", F.col("label") == F.col("top"))
    df = df.withColumn("block", F.explode(F.when(F.col("major"), F.array("k")).otherwise(F.sequence(F.lit(0), blocks - 1))))
    return df.withColumn("g", F.xxhash64("node", "block")).withColumn("home", F.col("block") == F.col("k")).drop("k", "block")


def _promising(members: DataFrame, threshold: int) -> DataFrame:
    """(g, id, label, n): members that have a candidate of another component in their group, by sketches.

    A pair that meets in several roots counts in the first small one only: ``tree`` is
    the number of the group's root, negative below; ``large`` has the bits of a
    member's roots that are branched instead. Two minority members are compared where
    the one with the smaller id is at home.
    """
    least = least_agreement(threshold)

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, label, n, tree, large = (t.column(c).to_numpy() for c in ("id", "label", "n", "tree", "large"))
        home, major = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "major"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
        path = t.column("path").combine_chunks().flatten().to_numpy().reshape(-1, ROOTS)
        usable = (large[:, None] >> np.arange(ROOTS)) & 1 == 0
        some = np.zeros(len(n), bool)
        for i in np.flatnonzero(~major):
            mine = major | (ids > ids[i]) if home[i] else major
            at = np.flatnonzero(mine & (label != label[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * threshold))
            if len(at):
                at = at[(sketch[at] == sketch[i]).sum(1) >= least]
            if len(at) and tree[i] >= 0:
                at = at[((path[at] == path[i]) & usable[at]).argmax(1) == tree[i]]
            if len(at):
                some[at] = some[i] = True
        if some.any():
            yield from t.select(["g", "id", "label", "n"]).filter(pa.array(some)).to_batches()

    return _in_groups(members.select("g", "id", "label", "n", "tree", "large", "home", "major", "sketch", "path"), compare, "g long, id long, label long, n long")


def _linked(docs: DataFrame, promising: DataFrame, id_col: str, text: str, words: int, threshold: int) -> DataFrame:
    """Links (a, b) that join the components of each group, confirmed on full sets; a component that is joined already gets no second link."""
    wanted = promising.select(F.col("id").alias(id_col)).distinct()
    one_row = docs.select(id_col, text).join(wanted.hint("merge"), id_col, "left_semi").dropDuplicates([id_col])
    sets = stash(full_sets(one_row, id_col, text, words), "sets")
    weight = promising.groupBy("g").agg(F.sum("n").alias("w")).withColumnRenamed("g", "node")
    dealt = _blocks(promising.withColumnRenamed("g", "node").join(weight, "node"), "node", F.col("w"), SET_ITEMS)

    def confirm(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        root = t.column("label").to_numpy().copy()
        lists = t.column("items").combine_chunks()
        items, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        # postings of each item: one pass gives a member's intersections with all others
        _, code = np.unique(items, return_inverse=True)
        order = np.argsort(code, kind="stable")
        posting, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
        starts = np.concatenate([[0], np.cumsum(n)])
        a, b = [], []
        for i in range(len(ids)):
            mine = code[starts[i] : starts[i + 1]]
            lens = first[mine + 1] - first[mine]
            at = np.arange(lens.sum()) + np.repeat(first[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
            both = np.bincount(posting[at], minlength=len(ids))
            close = np.flatnonzero((both * 100 >= (n + n[i] - both) * threshold) & (root != root[i]))
            for j in close.tolist():
                if root[j] != root[i]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = stash(_in_groups(dealt.join(sets, "id").select("g", "id", "label", "n", "items"), confirm, "a long, b long").distinct(), "links")
    drop(sets)
    return out


def _children(nodes: DataFrame) -> DataFrame:
    """Each member in ``BRANCHES`` children of its node, by the bytes of its sketch at places that hang on the node, so nodes of a tree choose independently."""
    places = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int") + 1 for k in range(BRANCHES)]
    keys = F.array(*[F.xxhash64("node", F.lit(k), F.col("sketch").substr(at, F.lit(1))) for k, at in enumerate(places)])
    return nodes.withColumn("node", F.explode(keys)).withColumn("tree", F.lit(-1))


def _mixed(members: DataFrame) -> DataFrame:
    """(node, m, top, minority): nodes with members of several components, their size, largest component, and members outside it."""
    sizes = members.groupBy("node", "label").agg(F.count("*").alias("c"))
    nodes = sizes.groupBy("node").agg(F.sum("c").alias("m"), F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), F.count("*").alias("parts"))
    return nodes.where("parts > 1").select("node", "m", "top", (F.col("m") - F.col("most")).alias("minority"))


def _labels(links: DataFrame) -> DataFrame:
    found = components(links)
    labels = stash(found, "labels")
    drop(found)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document row: id_col, n_shingles, component_id (smallest id of the group), kept.

    ``threshold`` is the least Jaccard similarity in percent.
    """
    sigs = stash(signatures(docs, id_col, text, words), "signatures")
    classes = stash(sigs.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch"), F.min_by("path", "id").alias("path"), F.count("*").alias("copies")), "classes")
    n_classes = classes.count()

    roots = F.array(*[F.xxhash64(F.lit(k), F.col("path")[k]) for k in range(ROOTS)])
    members = classes.select("id", F.posexplode(roots).alias("tree", "node"))
    nodes = stash(members.groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("first"), F.max("id").alias("last")).where("m > 1"), "nodes")
    # what many members share is broadcast in these joins, so no node gathers in a task
    shared = stash(look_up(members, nodes.withColumn("weight", F.col("m")), ["node"], "weight", n_classes * ROOTS).select("node", "tree", "id", "m", "first", "last"), "members")
    drop(nodes)
    stars = shared.select(F.col("first").alias("a"), F.col("id").alias("b")).unionAll(shared.select(F.col("id").alias("a"), F.col("last").alias("b")))
    sketches = classes.select("id", "n", "sketch")
    pairs = stash(_alike(stars.where("a < b").distinct(), sketches, threshold), "pairs")
    links = _confirmed(docs, pairs, id_col, text, words, threshold)
    drop(pairs)

    # what the stars left: nodes with members of several components, those of two members apart
    labels = _labels(links)
    marked = stash(shared.where("m > 2").join(labels, "id", "left").select("node", "tree", "id", F.coalesce("component", "id").alias("label")), "marked")
    drop(shared)
    mixed = stash(_mixed(marked), "mixed")
    bits = marked.join(mixed.where(F.col("minority") > SMALL).select("node"), "node").groupBy("id").agg(F.expr("bit_or(shiftleft(1, tree))").alias("large"))
    now = stash(look_up(marked, mixed.withColumn("weight", F.col("m")), ["node"], "weight", n_classes * ROOTS).join(bits, "id", "left").fillna(0, ["large"]).join(classes.select("id", "n", "sketch", "path"), "id"), "level")
    drop(marked, mixed)
    found = []
    for level in range(DEPTH + 1):
        found.append(stash(_promising(_spread(now.where(F.col("minority") <= SMALL)), threshold), "promising"))
        large = now.where(F.col("minority") > SMALL)
        if large.isEmpty():
            break
        if level == DEPTH:
            whole = _blocks(large, "node", F.col("m"), BLOCK).withColumn("home", F.lit(True)).withColumn("major", F.lit(False))
            found.append(stash(_promising(whole, threshold), "promising"))
            break
        kids = stash(_children(large.drop("m", "top", "minority")), "children")
        after = stash(kids.join(_mixed(kids), "node"), "level")
        drop(now, kids)
        now = after
    drop(now)
    rest = found[0]
    for more in found[1:]:
        rest = rest.unionAll(more)
    if not rest.isEmpty():
        more = _linked(docs, rest, id_col, text, words, threshold)
        both = links.unionAll(more)
        drop(labels)
        labels = _labels(both)
        drop(more)
    drop(links, *found)
    of_class = stash(classes.select("h1", "h2", "n", "id", "copies").join(labels, "id", "left").select("h1", "h2", F.col("n").alias("n_shingles"), "copies", F.coalesce("component", "id").alias("component_id")), "groups")
    drop(classes, labels)
    rows = sigs.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "h1", "h2")
    grouped = look_up(rows.where("n_shingles > 0"), of_class, ["h1", "h2", "n_shingles"], "copies", rows.count(), "left")
    out = grouped.unionByName(rows.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast(of_class.schema["component_id"].dataType)))
    group = F.coalesce("component_id", F.col(id_col))
    return out.select(id_col, "n_shingles", group.alias("component_id"), F.coalesce(F.col(id_col) == group, group.isNull()).alias("kept"))
