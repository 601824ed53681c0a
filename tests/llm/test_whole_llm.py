"""Operators do the whole job: whatever trees part, all roots, all offsets."""

import numpy as np
from pyspark.sql import functions as F

from gazeloom.llm import chroma, cpsjoin, wrappers


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Nodes that are branched as deep as they go lose no link, and what stays large is compared whole."""
    monkeypatch.setattr(cpsjoin, "SMALL", 6)
    monkeypatch.setattr(cpsjoin, "BLOCK", 8)
    monkeypatch.setattr(cpsjoin, "DEPTH", 3)
    rng = np.random.default_rng(5)
    common = " ".join(f"w{k}" for k in range(100))
    own = [" ".join(f"z{k}" for k in rng.integers(0, 10**6, 8)) for _ in range(40)]
    rows = [(2 * n + k, f"{common} {text}{' more' * k}") for n, text in enumerate(own) for k in range(2)]
    got = cpsjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=95).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i // 2 * 2) for i in range(80)]


def test_trees_keep_pairs_at_the_threshold(spark):
    """Pairs that agree in 0.8 of all minwise values share a node after five levels of branching; the stated loss is below 1e-6."""
    rng = np.random.default_rng(8)
    n, like = 2000, 0.8
    a = rng.integers(0, 256, (n, cpsjoin.POSITIONS), np.uint8)
    b = np.where(rng.random(a.shape) < like, a, rng.integers(0, 256, a.shape, np.uint8)).astype(np.uint8)
    root = rng.random((n, cpsjoin.ROOTS)) < like
    rows = [(p, w, int(k * 2 * n + 2 * p + (0 if root[p, k] else w)), k, x[p].tobytes()) for p in range(n) for w, x in enumerate((a, b)) for k in range(cpsjoin.ROOTS)]
    nodes = spark.createDataFrame(rows, "pair long, who int, node long, tree int, sketch binary").withColumn("node", F.xxhash64("node"))
    lost = []
    for _ in range(5):
        nodes = cpsjoin._children(nodes)
        met = nodes.groupBy("pair", "node").agg(F.countDistinct("who").alias("both")).where("both = 2")
        lost.append(n - met.select("pair").distinct().count())
    assert lost == [0] * 5


def test_main_text_of_several_roots():
    three = "<body><div><p>one</p></div><div><p>two</p></div><div><p>three</p></div></body>"
    assert wrappers.main_text(three, None) == "one two three"
    articles = "<main><article>first</article><nav>menu</nav><article>second</article></main>"
    assert wrappers.main_text(articles, None) == "first second"
    by_id = "<body><div id=top>logo</div><div id=content><p>the article</p></div><div id=sidebar>ads</div></body>"
    assert wrappers.main_text(by_id, None) == "logo the article"
    first_is_menu = "<body><div id=nav>menu</div><div id=content><p>the article</p></div><div class=x>note</div></body>"
    assert wrappers.main_text(first_is_menu, None) == "the article note"
    pages = [three.replace("one", f"one {n}").replace("three", f"three {n}") for n in range(3)]
    assert wrappers.main_text(pages[1], wrappers.induce(pages)) == "one 1 two three 1"


def test_unlike_siblings_are_all_content():
    """However the words are shared out between a page's blocks, none is lost."""
    for left in (5, 30, 50, 70, 95):
        pages = [f"<body><div class=k1>{' '.join(f'a{p}x{k}' for k in range(left))}</div><div class=k2><p>{' '.join(f'b{p}x{k}' for k in range(100 - left))}</p></div></body>" for p in range(6)]
        for n in (1, 2, 6):
            found = wrappers.induce(pages[:n])
            assert all(len(wrappers.main_text(x, found).split()) == 100 for x in pages)
    other = "<body><div class=k1>first of <b>all</b></div><section>a block that no other page has</section><ul><li>x<li>y</ul></body>"
    assert wrappers.main_text(other, wrappers.induce(pages)) == "first of all a block that no other page has x y"


def test_forms_around_the_page():
    text = "<h1>Title</h1><p>All of the page's words are in one form.</p>"
    plain = "Title All of the page's words are in one form."
    assert wrappers.main_text(f"<body><form action=x>{text}<input name=q><button>Go</button></form></body>", None) == plain
    assert wrappers.main_text(f"<body><form>{text}</form><form>{text}</form><p>rest</p></body>", None) == f"{plain} {plain} rest"
    assert wrappers.main_text(f"<body><div>{'long words outside ' * 20}</div><form><main>{text}</main></form></body>", None).endswith(plain)
    assert wrappers.main_text(f"<body>{text}<form>Search <input></form></body>", None) == plain
    assert wrappers.main_text(f"<body>{text}<form class=comment-form>{text * 9}</form></body>", None) == plain


def _site(rng, kind, host, pages):
    """Pages of a host and the words of their articles, known from how they are made."""
    word = lambda k=0: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    box, tail, heads = words(12), words(9), [words(1) for _ in range(3)]
    for n in range(pages):
        body = [words(rng.integers(20, 60)) for _ in range(rng.integers(2, 6))]
        title, said = words(6), words(15)
        truth = [title]
        inner = f"<h1>{title}</h1>"
        for k, x in enumerate(body):
            if kind == "headlines" and k < 3:
                inner += f"<h2>{heads[k]}</h2>"
                truth.append(heads[k])
            inner += f"<p>{x}<br>{k}</p>" if k % 2 else f"<div class=q{k}>{x} {k}</div>"
            truth.append(f"{x} {k}")
        if kind == "named":
            inner = f"<article class=post>{inner}</article>"
        elif kind == "unlike":
            inner = inner.replace("<div class=q0>", "</div><section><div class=q0>", 1).replace("</div>", "</div></section><div class=rest>", 2).replace("</div></section><div class=rest>", "</div>", 1)
            inner = f"<div class=one>{inner}</div>"
        else:
            inner = f"<div class=u1>{inner}</div>"
        page = f"<nav><a>{words(2)}</a></nav><header>{words(3)}</header><div class=x{host}>{box}</div>{inner}<div class=comments>{said}</div><aside>{words(8)}</aside><div class=z>{tail}</div><footer>{words(4)}</footer>"
        if kind == "form":
            page = f"<form action=/>{page}<input type=hidden value=1></form>"
        yield f"<html><head><title>{title}</title></head><body>{page}</body></html>", " ".join(truth).split(), set((box + " " + tail).split())


def test_generated_sites(spark):
    """Article words of all pages are found, whatever the layout and the number of pages; constant boxes go where at least four pages show them."""
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for kind in ("named", "unnamed", "unlike", "form", "headlines"):
        for n in range(1, 11):
            for page, words, boxes in _site(rng, kind, n, n):
                truth[len(rows)] = (kind, n, words, boxes)
                rows.append((len(rows), f"http://{kind}{n}.example.org/p", page))
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        kind, n, words, boxes = truth[r.page_id]
        found = r.text.split()
        if kind == "named" or n >= 5:
            assert found == words, (kind, n)
        else:
            rest = list(found)
            for w in words:
                rest.remove(w)
            assert set(rest) <= boxes, (kind, n)


def test_alignment_with_fewer_votes_than_a_held_tone(spark):
    """Three offsets of the held tone have the most votes but too little overlap; the true one has five votes."""
    rng = np.random.default_rng(2)
    sound, held = rng.integers(0, 2**32, 40), np.full(20, 12345)
    noisy = sound ^ (1 << rng.integers(0, 32, 40))
    noisy[10:19] = sound[10:19]
    rows = [(1, np.concatenate([noisy, held]).tolist()), (2, np.concatenate([held, sound]).tolist())]
    got = {r.id: r for r in chroma.align(spark.createDataFrame(rows, "id long, codes array<long>"), F.col("id") == 1).collect()}
    assert (got[1].n_links, got[1].best_class, got[1].best_offset) == (1, 2, 20)
    assert got[1].bit_error == 31 / (40 * 32)
