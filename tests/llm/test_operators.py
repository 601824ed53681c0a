"""Operators against brute force and on odd input: nulls, empty and repeated rows, empty tables, clashing columns."""

import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gazeloom.llm import bpe, chat, chroma, components, cpsjoin, feistel, langid, token_files, toxicity, wrappers, wumanber
from gazeloom.llm.storage import new_dir

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, ids string, n_words string, score string"
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "Hello, wörld! 😀 it's  fine\n\nok"), (4, "Hello, wörld! 😀 it's  fine\n\nok"), (5, "x" * 50_000), (6, "the of and " * 3000), (7, "\x01 \x1c \x85 é")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", None) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_bpe_round_trip(odd, spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    coded = bpe.encode(odd, RANKS, P.PATTERN, offsets=True)
    for r in bpe.decode(coded, RANKS).collect():
        text = r.text or ""
        assert list(r.ids) == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.decoded_text == text
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(text)
    cut = spark.createDataFrame([([enc.encode_ordinary("😀")[0]],), (None,), ([10**6],)], "ids array<int>")
    assert [r.decoded_text for r in bpe.decode(cut, RANKS).collect()] == ["�", "", ""]
    assert bpe.round_trip_digests(odd.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_files(odd, spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model, folder = Tokenizer.from_file(path), new_dir(spark, "t")
    bases = token_files.write_token_files(odd, folder, path, 1)
    got = token_files.read_token_files(spark, folder, "<u2", bases).orderBy("start").collect()
    start = 0
    for r, (i, text) in zip(got, sorted(ODD, key=lambda x: (x[0], x[1] or "")), strict=True):
        want = model.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, list(r.ids)) == (i, start, want)
        start += len(want)
    empty = token_files.write_token_files(odd.limit(0), new_dir(spark, "e"), path, 1)
    assert empty.count() == 0


def test_language_id(docs, odd):
    model = langid.fit(docs.where("doc_id % 3 <> 0"), docs_per_language=100)
    held = langid.predict(docs.where("doc_id % 3 = 0"), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(odd, langid.fit(odd.limit(0))).first().lang_pred == "und"


def test_chroma_alignment(spark):
    rng = np.random.default_rng(0)
    tones = lambda n: (np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(256) / 2048) for k in rng.integers(0, 24, n)]) * 9000).astype("<i2")
    one, two = tones(80), tones(80)
    cut = one[chroma.HOP * 20 :]
    noisy = (cut + rng.normal(0, 60, len(cut))).astype("<i2")
    rows = [(50, one.tobytes()), (1, noisy.tobytes()), (2, two.tobytes()), (3, one.tobytes()), (4, None), (5, b""), (100, b"\x01")]
    prints = chroma.add_fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), "id", "pcm")
    got = {r.id: r for r in chroma.align(prints, F.col("id") % 50 == 0).collect()}
    assert got[50].class_id == got[3].class_id == 3 and got[3].n_links == 1 and got[3].best_class == 1 and got[1].best_offset == 20
    assert all(got[i].n_links == 0 for i in (2, 4, 5, 100))
    assert len({got[i].class_id for i in (4, 5, 100)}) == 3


def test_chroma_alignment_finds_what_all_pairs_find(spark):
    """Shifted, cut and noisy copies: links against the bit errors of all pairs at all offsets."""
    rng = np.random.default_rng(4)
    tones = lambda n: (np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * np.arange(256) / 2048) for k in rng.integers(0, 24, n)]) * 9000).astype("<i2")
    made = [tones(70) for _ in range(8)]
    rows = []
    for one in made:
        for shift in (0, 7, 19):
            for noise in (0, 300, 2500):
                cut = one[chroma.HOP * shift : len(one) - chroma.HOP * int(rng.integers(0, 20))]
                rows.append((len(rows), np.clip(cut + rng.normal(0, noise + 1e-9, len(cut)), -32000, 32000).astype("<i2").tobytes()))
    rows += [(None, None), (None, b""), (len(rows), np.zeros(20000, "<i2").tobytes()), (len(rows) + 1, np.zeros(24000, "<i2").tobytes())]
    prints = chroma.add_fingerprints(spark.createDataFrame(rows, "id long, pcm binary").withColumn("codes", F.lit("clash")), "id", "pcm")
    codes = {r.id: np.array(r.codes, np.uint64) for r in prints.collect() if r.codes}
    want = set()
    for q in codes:
        for r in codes:
            if q < r and not np.array_equal(codes[q], codes[r]):
                x, y = codes[q], codes[r]
                for shift in range(chroma.MIN_OVERLAP - len(x), len(y) - chroma.MIN_OVERLAP + 1):
                    a, b = max(0, -shift), min(len(x), len(y) - shift)
                    if np.bitwise_count(x[a:b] ^ y[a + shift : b + shift]).sum() <= chroma.MAX_ERROR * 32 * (b - a):
                        want.add((q, r))
                        break
    got = {r.id: r for r in chroma.align(prints, F.lit(True)).collect() if r.id is not None}
    assert len(want) > 100
    found = sum(r.n_links for r in got.values())
    assert 0.9 * 2 * len(want) <= found <= 2 * len(want)
    whole = chroma.align(prints, F.lit(True))
    assert whole.count() == len(rows) and chroma.align(prints.limit(0), F.lit(True)).count() == 0


def test_language_id_against_sets(docs):
    """Predictions equal those of exact n-gram sets but for the filter's errors; more labels than a mask holds."""
    many = docs.withColumn("lang", F.concat("lang", F.pmod(F.col("doc_id"), F.lit(30)).cast("string")))
    model = langid.fit(many, docs_per_language=30, grams_per_language=3000)
    assert len(model.languages) > 64 and len(model.planes) > 1
    texts = [r.text or "" for r in docs.where("doc_id % 7 = 0").collect()]
    grams = {}
    points, owner, _ = langid.letter_stream(texts)
    hits, _ = model.scores(texts)
    for k in (0, 63, 64, len(model.languages) - 1):
        alone = langid.BitSlicedFilter([model.languages[k]], {model.languages[k]: grams.setdefault(k, _kept_grams(many, model.languages[k]))})
        assert np.allclose(alone.scores(texts)[0][:, 0], hits[:, k], atol=1e-6)


def _kept_grams(df, lang):
    labelled = df.where(F.col("lang") == lang)
    found = langid.count_grams(labelled, "text", "lang").orderBy(F.desc("n"), "gram").limit(3000).toPandas()
    return found.gram.to_numpy(np.int64).view(np.uint64)


def test_bpe_with_another_pattern(odd):
    import tiktoken

    pattern = r"\w+|\W"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in bpe.encode(odd.where("doc_id <> 5"), RANKS, pattern).collect():
        assert list(r.ids) == enc.encode_ordinary(r.text or "")


def test_token_files_are_read_in_ranges(spark, monkeypatch):
    """The same rows where documents are read a few at a time and from a file system that maps nothing."""
    monkeypatch.setattr(token_files, "READ_ROWS", 3)
    monkeypatch.setattr(token_files, "READ_TOKENS", 7)
    import pyarrow.fs as pafs

    folder = new_dir(spark, "r").removeprefix("file://")
    import os

    os.makedirs(folder)
    sizes = [1, 9, 2, 2, 2, 2, 2, 30, 1, 1, 1]
    starts = np.cumsum([0] + sizes)
    np.arange(starts[-1], dtype="<u2").tofile(f"{folder}/x.bin")
    np.stack([np.arange(len(sizes)) + 5, starts[:-1]], 1).astype("<i8").tofile(f"{folder}/x.idx")
    for fs in (pafs.LocalFileSystem(), pafs.SubTreeFileSystem("/", pafs.LocalFileSystem())):
        index, ids = (token_files._Integers(fs, f"{folder}/x.{x}", k) for x, k in (("idx", "<i8"), ("bin", "<u2")))
        rows = [(int(k), int(a), int(b)) for ks, aa, bb in token_files._document_rows(index, int(starts[-1])) for k, a, b in zip(ks, aa, bb, strict=True)]
        assert rows == [(i + 5, starts[i], starts[i + 1]) for i in range(len(sizes))]
        assert ids.range(3, 6).tolist() == [3, 4, 5]
        ids.close()


def test_toxicity(spark, docs, sf, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.select("doc_id", (F.col("toxic") * (2 - F.col("quality"))).alias("toxic")))
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2]
    weight = dict(zip(model.words, model.weights, strict=True))
    for r in toxicity.predict(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), model).collect():
        eta = sum(weight.get(w.decode(), 0.0) for w in set(wumanber.words_of(r.text)))
        above = [1 / (1 + np.exp(t - eta)) for t in model.thresholds]
        assert r.expected_severity == pytest.approx(sum(above)) and r.p_toxic == pytest.approx(above[0])
        assert r.severity == sum(x >= 0.5 for x in above) and r.toxic == (r.severity > 0)
    assert toxicity.predict(odd, model).columns == [c for c in odd.columns] + ["expected_severity", "p_toxic", "severity", "toxic"]
    assert toxicity.predict(odd.limit(0), model).count() == 0
    for none in (toxicity.fit(docs, labels.limit(0)), toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.where("toxic = 0"))):
        assert not toxicity.predict(odd, none).where("toxic OR severity > 0").count()


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(2)
    insults = ["scum", "twit", "lout", "oaf"]
    rows, marks = [], []
    for i in range(1200):
        grade = int(rng.choice([0, 0, 0, 1, 2]))
        words = [f"w{k}" for k in rng.integers(0, 400, 60)] + [str(x).upper() for x in rng.choice(insults, grade * 2, replace=False)]
        rows.append((i, " ".join(rng.permutation(words))))
        marks += [(i, 3 * grade), (i, None)] if i % 3 else []
    docs, labels = spark.createDataFrame(rows + rows[:50], "doc_id long, text string"), spark.createDataFrame(marks + [(None, 3), (5000, 3)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.grades.tolist() == [0, 3, 6]
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    n_insults = {i: len(set(t.lower().split()) & set(insults)) for i, t in rows}
    assert all(got[i].toxic == (n > 0) and got[i].severity == {0: 0, 2: 3, 4: 6}[n] for i, n in n_insults.items())


def test_distinct_words_agree_with_the_search(spark, docs, odd):
    for r in docs.select("text").unionByName(odd.select("text")).select("text", toxicity.distinct_words(F.col("text")).alias("words")).collect():
        assert sorted(w.encode() for w in r.words) == sorted(set(wumanber.words_of(r.text)))


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (3000, 3))
    eta = x @ [2.0, -1.0, 0.0] + rng.logistic(size=3000)
    y = (eta > 0).astype(int) + (eta > 1.5)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_cumulative_link(rows, cols, y, 3)
    assert w == pytest.approx([2, -1, 0], abs=0.25) and theta == pytest.approx([0, 1.5], abs=0.25)


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 5, None, None), (None, 0, "user", "x"), (5, 0, "user", "b"), (6, 0, "user", "a"), (6, 1, "assistant", "b"), (6, 2, "user", "c"), (7, 0, "user", "b"), (7, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(9))
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {4, 6, 7} and got[6].n_turns == 3
    assert got[4].rendered == "<|user|>\n<|end|>\n"
    assert chat.collapse(df.limit(0)).count() == 0


def _brute(texts, words, threshold):
    sets = {}
    for i, x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    held = {}
    for i, s in sets.items():
        for q in s:
            held.setdefault(q, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for q in s for j in held[q] if j < i).items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("small", "depth"), [(2048, 8), (6, 2)])
def test_near_duplicates(spark, docs, monkeypatch, small, depth):
    monkeypatch.setattr(cpsjoin, "SMALL", small)
    monkeypatch.setattr(cpsjoin, "BLOCK", max(8, small // 2))
    monkeypatch.setattr(cpsjoin, "DEPTH", depth)
    monkeypatch.setattr(cpsjoin, "SET_ITEMS", 4096 if small == 2048 else 600)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 500, 150)]
    made = [" ".join(w if k not in cut else f"z{n}" for k, w in enumerate(base)) for n in range(40) for cut in [set(rng.integers(0, 150, n % 9))]]
    rows = [(r.doc_id, r.text) for r in docs.limit(120).collect()] + [(1000 + n, t) for n, t in enumerate(made)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE two"), (2003, "ONE two")]
    want = _brute(rows, 3, 85)
    got = cpsjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")), words=3, threshold=85).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_of_a_large_node(spark):
    """More documents that share a passage than a node compares at once, with links that stars miss, at the real limits."""
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for n in range(2700):
        own = [f"o{n}_{k}" for k in range(int(rng.integers(8, 13)))]
        texts.append(passage + own)
        if n % 9 == 0:
            texts.append(passage + own[:-1] + [f"x{n}"])
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    want = _brute(rows, 5, 80)
    assert len({c for _, c in want.values()}) > cpsjoin.SMALL
    got = cpsjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_edge_cases(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "solo text here"), (None, None), (7, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in cpsjoin.near_duplicates(df, words=2).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (None, None, True), (None, None, True), (7, 7, True)], key=str)
    assert cpsjoin.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 40), (60, 50), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 31)) and got[60] == got[50] == 40
    assert components.components(edges.limit(0)).count() == 0


def test_benchmark_windows(spark, docs, sf, odd):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "the of"), (901, None), (902, "..."), (903, "hello")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    whole = wumanber.find_windows(table, items).collect()
    sharded = wumanber.find_windows(table, items, shard_bytes=3000).collect()
    key = lambda r: (r.doc_id, r.text or "")
    assert [tuple(r) for r in sorted(whole, key=key)] == [tuple(r) for r in sorted(sharded, key=key)]
    windows = {}
    for i, t in bench:
        w = wumanber.words_of(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    for r in whole:
        w, hit, found = wumanber.words_of(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
    assert wumanber.find_windows(odd, items.limit(0)).where("n_hit > 0").count() == 0


def _luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark, odd):
    text = "4111111111111111 4111-1111-1111-1111 4111111111111112 1987-02-28 28/02/1987 1987-02-30 10.0.0.1 +1 (743) 555-3824 a.b@x.org 7992739871300008 token = \"" + "ab12" * 10 + "\""
    assert _luhn("7992739871300008")
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "doc_id long, text string").withColumn("finds", F.lit("clash")).withColumn("New", F.lit("clash"))
    made = feistel.pseudonymise(df, "k")
    got = {r.doc_id: r for r in made.collect()}
    new = got[1].text.split(" ")
    assert got[1].text == got[4].text and got[1].finds == "clash" and len(got[1].text.split(" ")) == len(text.split(" "))
    assert new[0] == new[1].replace("-", "") != "4111111111111111" and new[2] == "4111111111111112" and new[5] == "1987-02-30"
    assert _luhn(new[0]) and "7992739871300008" in new
    assert new[3].split("-")[::-1] == new[4].split("/") and new[3] != "1987-02-28"
    for secret in ("10.0.0.1", "555-3824", "a.b@", "ab12ab12"):
        assert secret not in got[1].text
    assert got[2].text is None and got[3].text == "" and got[2].n_pseudonyms == 0
    assert feistel.pseudonymise(odd, "k").count() == len(ODD) and feistel.pseudonymise(odd.limit(0), "k").count() == 0
    back = {r.doc_id: r.text for r in feistel.pseudonymise(made, "k", invert=True).collect()}
    assert back == {1: text, 2: None, 3: "", 4: text}
    days = spark.range(0, 73000, 1).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert days.where("d < '1903-01-01'").select(feistel.permute_day(F.col("d"), "k").alias("p")).distinct().count() == 1095


def _values(kind, rng):
    """Many valid values of a kind."""
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    n = 1500
    if kind == "email":
        return [f"{pick('abAB12', 3)}@x.org" for _ in range(n)] + [f"{c}@x.org" for c in "abcXYZ019"]
    if kind == "hex":
        return [x for _ in range(n // 3) for x in (pick("0123456789abcdef", 32), pick("0123456789ABCDEF", 32), pick("0123456789", 32))]
    if kind == "secret":
        return [f"token={pick('abAB12-_', 14)}" for _ in range(n)]
    if kind == "ssn":
        return [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 55, 99) for s in rng.integers(1, 10000, 120)]
    if kind == "phone":
        return [f"+1 ({a:03}) {e:03}-{k:04}" for a, e, k in zip(rng.integers(0, 1000, n), rng.integers(0, 1000, n), rng.integers(0, 10000, n), strict=True)] + [f"+44 20 {k:04} {n:04}" for k in range(10)]
    if kind == "ipv4":
        return [".".join(map(str, x)) for x in rng.integers(0, 256, (n, 4))]
    if kind == "card":
        bodies = [f"4{k:014}" for k in rng.integers(0, 10**9, n)] + [f"37{k:012}" for k in range(50)]
        return [b + next(c for c in "0123456789" if _luhn(b + c)) for b in bodies]
    days = np.datetime64("1985-01-01") + np.arange(600)
    iso = [str(d) for d in days] + ["0001-01-01", "9999-12-31", "1899-12-31", "2099-11-13"]
    cut = [x.split("-") for x in iso]
    return iso + [f"{d}/{m}/{y}" for y, m, d in cut] + [f"{m}/{d}/{y}" for y, m, d in cut if int(d) > 12] + [f"{d}.{m}.{y}" for y, m, d in cut]


@pytest.mark.parametrize("kind", list(feistel.PATTERNS))
def test_pseudonyms_are_closed_and_invertible(spark, kind):
    values = sorted(set(_values(kind, np.random.default_rng(7))))
    made = feistel.pseudonymise(spark.createDataFrame([(v,) for v in values], "text string"), "k").withColumnRenamed("n_pseudonyms", "changed")
    both = made.withColumn("new", F.col("text"))
    rows = feistel.pseudonymise(both, "k", invert=True).select("new", "text", "changed").collect()
    new = [r.new for r in rows]
    assert [r.text for r in rows] == values and len(set(new)) == len(values)
    assert sum(r.changed for r in rows) > 0.99 * len(values)
    for v, x in zip(values, new, strict=True):
        assert re.fullmatch(feistel.PATTERNS[kind], x) and len(x) == len(v) or kind == "ipv4"
        if kind == "card":
            assert _luhn(x) and re.match(feistel.ISSUERS, x)
        if kind == "hex":
            assert (x == x.upper()) == (v == v.upper()) or not re.search("[A-F]", v)
        if kind == "phone" and re.match(r"\+1 \([2-9]..\) [2-9]", v):
            assert re.match(r"\+1 \([2-9]..\) [2-9]", x)


PAGE = "<html><body><header>Site</header><nav><a>Home</a></nav><div class='sidebar'>Side {n}</div><div id='post'><h1>T{n}</h1><p>Body &amp; <b>bo</b>ld {n}<br>x<p>more {n} words here that vary {n}</div><form>f</form><div class='comments'>c{n}</div><footer>F</footer><script>'</p>'</script></body></html>"


def test_main_text(spark):
    rows = [(n, "http://h.org/a", PAGE.replace("{n}", f"n{n}")) for n in range(5)] + [(9, None, "<article>solo  one</article><footer>no"), (10, "http://h.org", None), (11, "x", ""), (12, "x", "plain & simple")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    for n in range(5):
        assert got[n].text == f"Tn{n} Body & bold n{n} x more n{n} words here that vary n{n}" and got[n].n_chars == len(got[n].text)
    assert [got[k].text for k in (9, 10, 11, 12)] == ["solo one", "", "", "plain & simple"]
    assert wrappers.extract(df.limit(0)).count() == 0


UNLISTED = "<body><div class='x7'>Welcome to the site of all things</div><article class='notice'><h1>T{n}</h1><div class='q3'>Read this on paper</div><p>Own <i>words</i> of page {n} and of no other, which go on for a good while {n}, and then for a while longer, so that notices are a small part of it all.</p><p>second {n} and third {n}</p><p>Read this on paper</p><div class='related-work'>earlier studies {n}</div><div class='related-posts'>see also {n}</div><div id='comments'>first! {n}</div></article><div class='x9'>All rights kept</div></body>"


def test_main_text_takes_slots_and_leaves_the_template():
    pages = [UNLISTED.replace("{n}", f"n{k}") for k in range(6)]
    wrapper = wrappers.induce(pages)
    assert len(wrapper) == 4
    for k in (0, 3, 9):
        n = f"n{k}"
        assert wrappers.main_text(UNLISTED.replace("{n}", n), wrapper) == f"T{n} Own words of page {n} and of no other, which go on for a good while {n}, and then for a while longer, so that notices are a small part of it all. second {n} and third {n} earlier studies {n}"
    # copies of one article are no template, and a few pages make none
    assert wrappers.induce(pages[:1] * 5) == wrappers.induce(pages[:3]) == []
    copies = [p.replace("second", f"second{k}") for k, p in enumerate(pages[:1] * 6)]
    assert wrappers.induce(copies) == []
    # slots alone are content where no tag names it
    plain = "<body><div class='a'>Site of all things</div><div class='b'><div class='c'><p>Text of {n} goes {n}</p></div><div class='d'>{n}</div></div><div class='e'>Site end</div></body>"
    assert wrappers.main_text(plain.replace("{n}", "page9"), wrappers.induce([plain.replace("{n}", f"page{k}") for k in range(5)])) == "Text of page9 goes page9 page9"
    assert [wrappers._names(x, wrappers.FURNITURE_WORDS) for x in ("related-posts", "related-work", "ad", "ad-300x250", "site-footer", "notice-of-intent", "text")] == [True, False, True, True, True, False, False]


def _leaked(texts, items):
    """Ids of documents that the contract's rule calls contaminated."""
    windows = {}
    for t in items:
        w = wumanber.words_of(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    out = set()
    for i, t in texts.items():
        w, hit = wumanber.words_of(t), set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def test_pipeline(spark, sf):
    """Each stage against brute force on what the one before kept."""
    import corpus_pipeline
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    all_docs, tables = texts(docs), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, sf), name)
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
        tables.append(texts(docs))
    known, single, clean, private = tables
    letters = {i for i, t in all_docs.items() if any(c.isalpha() for c in t or "")}
    assert set(known) <= letters and len(known) >= 0.99 * len(letters)
    groups = _brute(list(known.items()), 5, 80)
    assert set(single) == {i for i, (_, c) in groups.items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(clean) == set(single) - _leaked(single, items)
    assert set(private) == set(clean) and all(private[i] == clean[i] or re.search("[0-9@]|token", clean[i]) for i in clean)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    out = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == {i: enc.encode_ordinary(t) for i, t in private.items()}


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    rows = [(None, "some words here", None), (1, None, None), (2, "", None), (3, "x" * 60_000, None), (4, "a few words", None), (4, "a few words", None), (5, "A few words", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("source", "n_chars", "score", "lang_pred", "n_words", "items", "kept", "row", "finds", "ids", "id", "n")})
    for df, want in ((odd, len(rows) - 1), (odd.limit(0), 0), (odd.withColumn("lang", F.lit("en")), 4)):
        docs = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stash(stage(spark, docs, sf), name)
            assert docs.columns == odd.columns
        assert docs.count() == want and corpus_pipeline.tokens(spark, docs, sf).count() == want


def test_main_text_of_odd_markup():
    deep = "<div>" * 3000 + "in<p>a</p><nav>menu<b>x</b></nav>b" + "</div>" * 3000
    assert wrappers.main_text(deep, None) == "in a b"
    assert wrappers.main_text("<article><p>text</p><a href=x", None) == "text"
    assert wrappers.main_text("<p>x</p>" + "<a" * 50_000, None).startswith("x")
    wide = "<article>" + "".join(f"<h2 class='r{k}'>t{k}</h2><p>x</p>" for k in range(3000)) + "</article>"
    assert len(wrappers.main_text(wide, None).split()) == 6000
    assert wrappers.induce([wide, wide.replace("t", "u")]) == wrappers.induce([deep, deep.replace("in", "out")]) == []


def test_benchmark_item_without_id(spark):
    items = spark.createDataFrame([(None, "a b"), ("q", "a b"), (None, "c")], "item_id string, text string")
    got = wumanber.find_windows(spark.createDataFrame([(1, "x a b c")], "doc_id long, text string"), items).first()
    assert (got.n_words, got.n_hit, got["items"]) == (4, 3, ["q"])
