"""HTML extraction by wrapper induction over pages of one host.

A bounded sample of each host's pages (``PAGES_PER_HOST``, chosen by a hash of the
page) is parsed into trees of blocks whose runs of like siblings are folded. Simple
tree matching aligns the trees: a block's text that stands in the matching node of
every sampled page is constant and becomes template, all other text is a slot. The
wrapper of a host is the set of digests of its template blocks, each with its path.

Every page is then parsed whole and all its slots are content. If ``article`` and
``main`` elements hold at least half of the slots' text, the outermost of them are the
content and what is outside goes. Names decide only what alignment can't: slots in
elements, roles or classes of page furniture (menus, adverts, reader comments vary from
page to page, too) are left out. A class word counts if the rest of its class name is
neutral, so ``related-posts`` is furniture and ``related-work`` is not; ``article`` and
``main`` are never furniture by their class, unless it is that of a comment. A ``header``
is furniture where it heads the whole page, not a part of it. A ``form`` is furniture
unless it encloses an ``article`` or ``main`` element, or forms hold more of the page's
text than all else: then they are wrappers.

Pages that repeat one text are copies, not a template: constant blocks are template
only where ``MIN_PAGES`` or more pages are aligned and less than ``MAX_CONSTANT`` of the
text outside furniture is constant. A constant headline stays if slots follow it before
the next one. A page without any slot keeps its constant text.

Wrappers are small; they are broadcast only if their measured size is below
``BROADCAST_BYTES`` and joined by host otherwise. Edge cases: null or empty html gives
an empty text, a null or odd url counts as the host ``''``; repeated pages get a row
each; text that no tag encloses belongs to the root; a tag that the end of the page
cuts off is dropped; elements nested more than ``MAX_DEPTH`` deep are read as content
of the deepest open one, so all work is linear in the page however deep its tree is;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import free_name, slices, text_of
from .storage import stash

PAGES_PER_HOST = 8
#: Aligned pages that constant text needs to be template, and the share of their text from which they are copies instead.
MIN_PAGES, MAX_CONSTANT = 4, 0.5
BROADCAST_BYTES = 8_000_000
#: Open elements beyond which a tree grows no deeper (browsers stop at about as many).
MAX_DEPTH = 500
#: Siblings beyond which alignment folds those of one label, then those of one tag, though they are no run.
WIDE, WIDEST = 64, 256

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("img a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element of the given kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
SCOPES = frozenset("article aside body div footer form header html main nav ol section table ul".split())
#: Elements, roles and name words of page furniture.
FURNITURE_TAGS = frozenset("nav footer aside form button select textarea input script style noscript template iframe svg canvas dialog head title menu object embed".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Words that leave a class name furniture, besides those of at most two letters.
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons center col column container content desktop entry fixed floating form header holder inner item items left links list main mobile module outer page panel post posts right row section side site slot sponsors sticky thread title top unit user view wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments replies reply respond".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Elements that enclose a whole page, besides the only block of such an element.
PAGE_TAGS = frozenset(("#root", "html", "body", "form"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: A tag that the end of the page cuts off.
_CUT = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element with its children (nodes and text strings); ``form`` if only its tag makes it furniture."""

    __slots__ = ("tag", "label", "furniture", "form", "kids")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.kids = tag, []
        name = ""
        self.furniture = named = False
        if raw and "=" in raw:
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
            names = (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()
            name = " ".join(attributes.get("class", "").lower().split())
            hidden = attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""))
            known = COMMENT_WORDS if tag in CONTENT_TAGS else FURNITURE_WORDS
            named = attributes.get("role", "").lower() in FURNITURE_ROLES or bool(hidden) or any(_names(x, known) for x in names)
        self.furniture = named or tag in FURNITURE_TAGS
        self.form = tag == "form" and not named
        self.label = f"{tag}.{name}" if name else tag


def _names(token: str, known: frozenset) -> bool:
    """Whether a class or id names furniture: one of its words does, the rest is neutral."""
    words = _WORD.findall(token)
    return not known.isdisjoint(words) and all(len(w) < 3 or w in FURNITURE_WORDS or w in NEUTRAL_WORDS for w in words)


def parse(page: str | None) -> Node:
    """The page's tree, in which headers and forms are judged by their place."""
    root = _tree(page)
    _deep(_settle, root)
    return root


def _settle(root: Node) -> None:
    """Headers of the page become furniture, forms around its content don't stay it."""
    forms: list[tuple[Node, int, bool]] = []

    def walk(n: Node, heads: bool) -> tuple[int, bool]:
        """Letters outside furniture below a node, and whether a content element is among them."""
        size, content = 0, n.tag in CONTENT_TAGS
        blocks = [k for k in n.kids if not isinstance(k, str) and not _is_inline(k) and not (k.furniture and not k.form)]
        for kid in n.kids:
            if isinstance(kid, str):
                size += len(kid.strip())
            else:
                if kid.tag == "header" and heads:
                    kid.furniture = True
                if not kid.furniture or kid.form:
                    more, inner = walk(kid, heads and (kid.tag in PAGE_TAGS or len(blocks) == 1 and kid.tag not in CONTENT_TAGS))
                    content = content or inner
                    size += more
        if n.form:
            forms.append((n, size, content))
            return 0, content
        return size, content

    outside, _ = walk(root, True)
    wrap = sum(size for _, size, _ in forms) > outside
    for form, _, content in forms:
        if content or wrap:
            form.furniture = False


def _tree(page: str | None) -> Node:
    """The page's elements, built leniently: void and raw elements, implied ends of p, li and table cells, unmatched ends ignored."""
    root = Node("#root")
    open_nodes, at, page = [root], 0, page or ""
    # elements below the deepest level: (tag, is furniture), how many of each tag, how many are furniture
    beyond: list[tuple[str, bool]] = []
    counts: dict[str, int] = {}
    hidden = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else _CUT.sub("", page[at:])
        if text and not hidden:
            open_nodes[-1].kids.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if beyond and m[1]:
            if not counts.get(tag) and any(n.tag == tag for n in open_nodes):
                beyond, counts, hidden = [], {}, 0
            elif counts.get(tag):
                name = ""
                while name != tag:
                    name, furniture = beyond.pop()
                    counts[name] -= 1
                    hidden -= furniture
                if tag not in INLINE:
                    open_nodes[-1].kids.append(" ")
                continue
            else:
                continue
        if m[1]:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in SCOPES and tag not in SCOPES:
                    break
            continue
        closing = None if beyond else {"p"} if tag in ENDS_P else CLOSES.get(tag)
        if closing:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in closing:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in SCOPES:
                    break
        node = Node(tag, m[3])
        if not hidden:
            open_nodes[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            if tag in ("title", "textarea"):
                node.kids.append(html_lib.unescape(page[at : end.start()]))
            at = end.end()
            continue
        if m[3].endswith("/"):
            continue
        if beyond or len(open_nodes) > MAX_DEPTH:
            beyond.append((tag, node.furniture))
            counts[tag] = counts.get(tag, 0) + 1
            hidden += node.furniture
        else:
            open_nodes.append(node)


def _is_inline(node: Node) -> bool:
    """Whether an element is part of the text around it: inline, without blocks in it."""
    return node.tag in INLINE and all(isinstance(k, str) or _is_inline(k) for k in node.kids)


def own_text(node: Node) -> str:
    """A block's own text with that of its inline elements, without its child blocks, white space runs as one space."""
    parts: list[str] = []

    def walk(n: Node) -> None:
        for kid in n.kids:
            if isinstance(kid, str):
                parts.append(kid)
            elif _is_inline(kid):
                if not kid.furniture:
                    walk(kid)
            else:
                parts.append(" ")

    walk(node)
    return " ".join("".join(parts).split())


def _digest(path: list[str], text: str) -> str:
    return hashlib.blake2b("\n".join([*path, text]).encode(), digest_size=8).hexdigest()


def _slots(root: Node, template: frozenset[str] | set[str]) -> tuple[int, int]:
    """Letters of slots outside furniture, and how many of them are in content elements."""
    sums = [0, 0]

    def walk(n: Node, path: list[str], inside: bool) -> None:
        inside = inside or n.tag in CONTENT_TAGS
        own = own_text(n)
        if own and not (template and _digest(path, own) in template):
            sums[0] += len(own)
            sums[1] += len(own) * inside
        for kid in n.kids:
            if not isinstance(kid, str) and not kid.furniture and not _is_inline(kid):
                walk(kid, [*path, kid.label], inside)

    walk(root, [], False)
    return sums[0], sums[1]


def _text(root: Node, template: frozenset[str] | set[str], named: bool) -> str:
    """Blocks in page order, white space runs as one space, template and furniture left out; of content elements only if they are ``named``."""
    parts: list[str] = []

    def walk(n: Node, path: list[str], skip: bool, taken: bool) -> None:
        block = n.tag not in INLINE
        taken = taken or n.tag in CONTENT_TAGS
        if block:
            parts.append(" ")
        if template and not _is_inline(n):
            skip = _digest(path, own_text(n)) in template
        for kid in n.kids:
            if isinstance(kid, str):
                if taken and not skip:
                    parts.append(kid)
            elif not kid.furniture:
                walk(kid, path if _is_inline(kid) else [*path, kid.label], skip, taken)
        if block:
            parts.append(" ")

    walk(root, [], False, not named)
    return " ".join("".join(parts).split())


def _deep(fn, *args):
    """Call a function that recurses a few frames for each of the at most ``MAX_DEPTH`` levels."""
    import sys

    if sys.getrecursionlimit() < 20 * MAX_DEPTH:
        sys.setrecursionlimit(20 * MAX_DEPTH)
    return fn(*args)


class Folded:
    """A block for alignment: label, own texts, and child blocks in which runs of one label are one node."""

    __slots__ = ("label", "parts", "kids", "furniture", "headline")

    def __init__(self, node: Node):
        self.label, self.furniture, self.headline = node.label, node.furniture, node.tag in HEADLINES
        own = own_text(node)
        self.parts = [own] if own else []
        self.kids: list[Folded] = []
        for k in node.kids:
            if not isinstance(k, str) and not _is_inline(k):
                f = Folded(k)
                if self.kids and (self.kids[-1].label, self.kids[-1].furniture) == (f.label, f.furniture):
                    self.kids[-1].absorb(f)
                else:
                    self.kids.append(f)
        self._narrow()

    def _narrow(self) -> None:
        if len(self.kids) > WIDE:
            self._fold(lambda k: k.label)
        if len(self.kids) > WIDEST:
            self._fold(lambda k: k.label.split(".")[0])

    def _fold(self, name) -> None:
        by: dict[tuple[str, bool], Folded] = {}
        for k in self.kids:
            first = by.setdefault((name(k), k.furniture), k)
            if first is not k:
                first.absorb(k)
        self.kids = list(by.values())

    def absorb(self, other: Folded) -> None:
        self.parts += other.parts
        for k in other.kids:
            same = next((x for x in self.kids if (x.label, x.furniture) == (k.label, k.furniture)), None)
            if same:
                same.absorb(k)
            else:
                self.kids.append(k)
        self._narrow()


def match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: size of the largest order-preserving top-down matching, and its pairs of nodes."""
    if a.label != b.label:
        return 0, []
    n, m = len(a.kids), len(b.kids)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = match(a.kids[i - 1], b.kids[j - 1]) if a.kids[i - 1].label == b.kids[j - 1].label else (0, [])
            sub[i, j] = w
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[0])
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if sub[i, j][0] and best[i][j] == best[i - 1][j - 1] + sub[i, j][0]:
            pairs += sub[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs


def induce(pages: list[str]) -> list[str] | None:
    """The wrapper of one host's pages: digests of the template blocks; none without two pages to align."""
    trees = [Folded(parse(p)) for p in pages if p]
    if len(trees) < 2:
        return None
    first = trees[0]
    constant: dict[int, set[str]] = {}
    met: dict[int, int] = {}
    for other in trees[1:]:
        for a, b in match(first, other)[1]:
            constant[id(a)] = constant.get(id(a), set(a.parts)) & set(b.parts)
            met[id(a)] = met.get(id(a), 0) + 1
    # constant is what matched in every page
    for k, n in met.items():
        if n < len(trees) - 1:
            constant[k] = set()
    template: list[str] = []
    sizes = [0, 0]

    def note(n: Folded, at: list[str]) -> bool:
        """Notes the template below a node; whether there are slots, too."""
        same = constant.get(id(n), set())
        found = any(x not in same for x in n.parts)
        for x in n.parts:
            sizes[x in same] += len(x)
        template.extend(_digest(at, x) for x in sorted(same))
        kids = [k for k in n.kids if not k.furniture]
        kept, slots = [len(template)], []
        for k in kids:
            slots.append(note(k, [*at, k.label]))
            kept.append(len(template))
        for i in range(len(kids) - 1, -1, -1):
            after = next((j for j in range(i + 1, len(kids)) if slots[j] or kids[j].headline), None)
            if kids[i].headline and not slots[i] and after is not None and slots[after]:
                del template[kept[i] : kept[i + 1]]
        return found or any(slots)

    note(first, [])
    return sorted(set(template)) if len(trees) >= MIN_PAGES and sizes[1] < MAX_CONSTANT * sum(sizes) else []


def main_text(page: str | None, wrapper: list[str] | None) -> str:
    """The main text of one page under the template of its host."""
    if not page:
        return ""

    def read() -> str:
        root, template = parse(page), frozenset(wrapper or ())
        slots, named = _slots(root, template)
        if not slots:
            template = frozenset()
            slots, named = _slots(root, template)
        return _text(root, template, 0 < slots <= 2 * named)

    return _deep(read)


def host_of(url):
    """The host of a url, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", pages_per_host: int = PAGES_PER_HOST) -> DataFrame:
    """(host, wrapper string): the induced wrapper of each host as JSON, null where the sample has no common structure.

    The sample is one page for each of ``pages_per_host`` hash cells of a host, so a
    host with a third of all pages needs no more than the others and map tasks
    already keep one page a cell.
    """
    mark = F.xxhash64(F.col(url), F.col(html))
    keyed = pages.where(F.length(html) > 0).select(host_of(url).alias("host"), F.pmod(mark, F.lit(pages_per_host)).alias("cell"), mark.alias("mark"), F.col(html).alias("html"))
    cells = keyed.groupBy("host", "cell").agg(F.min_by("html", "mark").alias("html"))
    packed = cells.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("cell", "html"))).alias("sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                found = _deep(induce, [x["html"] for x in row.column("sample")[0].as_py()])
                yield pa.RecordBatch.from_pydict({"host": row.column("host"), "wrapper": pa.array([None if found is None else json.dumps(found)], pa.string())})

    return packed.mapInArrow(run, "host string, wrapper string")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add ``text string`` (main text) and ``n_chars long`` to pages; columns of these names are replaced."""
    found = stash(wrappers(pages, url, html), "wrappers").where("wrapper IS NOT NULL")
    size = found.agg(F.sum(F.length("host") + F.length("wrapper") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = found.hint("broadcast")
    names = ["text", "n_chars"]
    kept = [c for c in pages.columns if c not in names]
    host_of_page, page, wrapper = (free_name(pages, n) for n in ("host", "page", "wrapper"))
    keyed = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html).alias(page), host_of(url).alias(host_of_page))
    joined = keyed.join(found.select(F.col("host").alias(host_of_page), F.col("wrapper").alias(wrapper)), host_of_page, "left").drop(host_of_page)
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            texts = [main_text(x, json.loads(w) if w else None) for x, w in zip(text_of(batch, page), batch.column(wrapper).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=kept + names)

    return joined.mapInArrow(run, schema)
