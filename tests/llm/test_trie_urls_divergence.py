"""Prefix tries, URL filters and divergence audits against brute force, SQL and odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import divergence, joins, queries, trie, url_filter

TURNS = "conv_id long, turn long, role string, text string, d string, weight string"


def _trie_of(rows):
    """Nodes by plain sets: rows (conv_id, turn, role, text) without ties."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(ids) if built[c] == p).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else None
        out[min(ids), len(p)] = (parent, len(ids), len(kids), len(leaves), saved, ends)
    return out


def _nodes(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.trie(*trie.forked(trie.placed_turns(df))).collect()}


def test_trie_is_that_of_sets(spark):
    rng = np.random.default_rng(3)
    words = ["", "a", "é😀", "b" * 7]
    rows = [(c, t if t else None, [None, "user", ""][rng.integers(3)] if t > 2 else "user", words[rng.integers(len(words))] if t else "hello") for c in [*range(0, 40), *range(100, 130), *range(205, 230), *range(-105, -95)] for t in range(rng.integers(1, 8))]
    rows += [(300, t, "user", "long" if t % 3 else "turn") for t in range(120)] + [(399, t, "user", "long" if t % 3 else "turn") for t in range(110)]
    rows += [(None, 0, "user", "no id"), (500, None, None, None)]
    rows += [(c, t, "user", "copy") for c in range(600, 640) for t in range(3)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(3)
    assert _nodes(df) == _trie_of(rows)
    assert _nodes(df.limit(0)) == {}


def test_trie_with_hot_keys_broadcast(spark, monkeypatch):
    """Low limits take both ways of each join."""
    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    monkeypatch.setattr(joins, "HOT_KEYS", 10)
    rows = [(c, t, "user", f"{t if c % 3 else c}") for c in range(90) for t in range(1 + c % 7)]
    assert _nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == _trie_of(rows)


def test_trie_of_a_staircase(spark):
    """Each conversation leaves the one before it a turn later: as many generations as turns."""
    rows = [(c, t, "user", "same" if t < c - 100 else f"own {c} {t}") for c in range(101, 131) for t in range(c - 100 + 2)]
    assert _nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == _trie_of(rows)


def test_running_totals_across_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(7 if k < 300 else int(rng.integers(20)), k, int(rng.integers(-50, 50)), int(rng.integers(2**40))) for k in range(500)]
    got = joins.running(spark.createDataFrame(rows, "id long, k long, a long, b long").repartition(5), "id", ["k"], sums=["a"], xors=["b"]).collect()
    for c, own in groupby(sorted(rows), key=lambda r: r[0]):
        own = list(own)
        want = [(k, int(a), int(b)) for (_, k, _, _), a, b in zip(own, np.cumsum([r[2] for r in own]), np.bitwise_xor.accumulate([r[3] for r in own]), strict=True)]
        assert sorted((r.k, r.a, r.b) for r in got if r.id == c) == want


def test_list_digests_over_many_pieces(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 25_000, 1).otherwise(F.col("id") % 40).cast("long").alias("key"), (F.col("id") * 7 - 90).alias("number"))
    ids = defaultdict(list)
    for r in df.collect():
        ids[r.key].append(r.number)
    got = {r.key: r.sha256 for r in trie.list_digests(df, ["key"], "number").collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "HTTP://example.net/EN/", "https://example.net?x=/en/", "ftp://u:p@b.example.com:80/de/1", "x://org/fr/", "x://notorg/fr/", "http://a.org/fr", "http://a.org/fr/#/", "a://b://net/", "http://net/", "http://net", "http://ünï.org/fr/é", "http://x.net/a\nb/?q", "http://big.com/" + "ab/" * 30_000]


def _judged(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash", None) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, verdict string, url_grams string")
    got = url_filter.judge(df, url_filter.fit(df.limit(0).select("url", "verdict")), queries.URL_RULES).orderBy("page_id").collect()
    for r, u in zip(got, [*URLS, *URLS], strict=True):
        host, path, rule, verdict = _judged(u)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_url_model(spark):
    """Held-out accuracy, its scores against plain sums of weights, one-sided and empty tables."""
    rng = np.random.default_rng(0)
    bad, good = ["casino", "pills", "jackpot"], ["library", "school", "weather"]
    rows = [(f"https://{''.join(rng.choice(list('abcdefgh'), 4))}{w}.com/{w2}/{rng.integers(900)}.html", v) for v, ws in (("block", bad), ("allow", good)) for _ in range(300) for w, w2 in [(ws[rng.integers(3)], ws[rng.integers(3)])]]
    df = spark.createDataFrame(rows, "url string, verdict string")
    train, held = df.where("pmod(xxhash64(url), 3) <> 0"), df.where("pmod(xxhash64(url), 3) = 0").withColumnRenamed("verdict", "truth")
    model = url_filter.fit(train)
    got = url_filter.judge(held, model).collect()
    assert sum(r.verdict == r.truth for r in got) >= 0.98 * len(got)
    again = url_filter.judge(held, url_filter.fit(train.repartition(7, "url"))).collect()
    assert sorted((r.url, r.verdict) for r in got) == sorted((r.url, r.verdict) for r in again)
    w, bias = model.regression.coefficients.toArray(), model.regression.intercept
    host, path = url_filter.parts(F.col("url"))
    marked = url_filter._hashed(held.select("url", url_filter.grams(host, path).alias("g")), "g", "f", model.features).collect()
    verdict = {r.url: r.verdict for r in got}
    for r in marked:
        want = {f"{side}{n}{s[k : k + n]}" for side, s in zip("hp", (f".{_judged(r.url)[0]}.", _judged(r.url)[1]), strict=True) for n in url_filter.ORDERS for k in range(len(s) - n + 1)}
        assert set(r.g) == want and len(r.g) == len(want)
        assert verdict[r.url] == ("block" if w[r.f.indices].sum() + bias > 0 else "allow")
    assert url_filter.fit(train.where("verdict = 'block'")).otherwise == "block" and url_filter.fit(train.limit(0)).otherwise == "allow"
    assert url_filter.judge(held.limit(0), model, queries.URL_RULES).count() == 0
    few = url_filter.judge(held, url_filter.fit(train, max_labelled=60)).collect()
    assert len(few) == len(got)


def _audited(rows, min_docs, top):
    """The audit by its definition, pair by pair and term by term."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for w, n in docs[lang].items() if n >= min_docs), key=str.encode)
        own = sorted(s for k, s in groups if k == lang)
        share = lambda n, total: 1 + 10**9 * (n + 2) // (total + 2 * len(kept))
        p = {s: [share(count[lang, s][w], sum(count[lang, s][x] for x in kept)) for w in kept] for s in own}
        whole = [sum(count[lang, s][w] for s in own) for w in kept]
        q = [share(n, sum(whole)) for n in whole]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(map(f, p[s], p[t])), t.encode()) for t in own if t != s))
            terms = sorted((-f(a, b), w.encode()) for a, b, w in zip(p[s], q, kept, strict=True) if a > b and count[lang, s][w])[:top]
            out += [(lang, s, part, x.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, x) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [64, 3])
def test_divergence_is_that_of_the_definition(spark, block):
    rng = np.random.default_rng(4)
    words = ["The", "the", "Straße", "ÉTÉ", "été", "don't", "x1y", "😀", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), ["en", "de", None][rng.integers(3)], ["s0", "s1", "S1", "", None, "é", "s2", "s3"][min(rng.integers(12), 7)]) for _ in range(260)]
    rows += [(None, "en", "s0"), ("", "xx", None), ("12 _", "xx", "lone"), ("rare", "yy", "only"), ("the " * 20_000, "en", "hot")]
    rows += [("copy of the copy", "en", "hot")] * 40
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "text string, lang string, source string, n string, term string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=6, block=block, shares=2, rows_at_once=16).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _audited(rows, 6, 10)
    assert divergence.audit(df.limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    rows = [(3 * 10**12, 9 * 10**17, 10**6), (0, 0, 0), (0, 0, 5), (10**10, 10**10, 1)]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    got = [r.p for r in df.select(divergence.share_of(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * k) if t + k else 1 for n, t, k in rows]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_url_query_covers_its_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op12_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        host, path, rule, verdict = _judged(r.url)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule)
        assert got[r.page_id].verdict == verdict if rule else got[r.page_id].verdict in ("allow", "block")
