"""Held tones, other tokenizer files, many benchmark shards, cut characters, hot keys in joins, chosen penalties."""

import time

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

from gazeloom.llm import bpe, chroma, components, joins, token_files, toxicity, wumanber
from gazeloom.llm.storage import new_dir


def test_held_tone_of_an_hour(spark):
    rng = np.random.default_rng(0)
    own = rng.integers(0, 2**32, 300)
    one = np.concatenate([np.full(100_000, 77), own, np.full(500, 77)])
    two = np.concatenate([np.full(60_000, 77), own ^ (1 << rng.integers(0, 32, 300)), np.full(90, 77)])
    other = rng.integers(0, 2**32, 400)
    df = spark.createDataFrame([(1, one.tolist()), (2, two.tolist()), (3, other.tolist())], "id long, codes array<long>")
    began = time.time()
    got = {r.id: r for r in chroma.align(df, F.col("id") == 1).collect()}
    assert time.time() - began < 60
    # overlaps of nothing but the tone have no wrong bit, so the first of them is the best
    assert (got[1].n_links, got[1].best_class, got[1].bit_error) == (1, 2, 0) and got[3].n_links == 0
    assert got[1].best_offset == chroma.MIN_OVERLAP - len(one)
    wrong, over = chroma.bit_errors(one, two)
    assert (wrong[len(one) - 1 - 40_000], over[len(one) - 1 - 40_000]) == (300, 60_390)


def test_histogram_of_runs_is_that_of_steps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.repeat(rng.integers(0, 4, 12), rng.integers(1, 9, 12)).tolist()) for i in range(6)]
    classes = spark.createDataFrame(rows, "class_id long, codes array<long>")
    every = chroma._keys(classes, "r", "r").withColumn("salt", F.lit(0))
    got = {(r.q, r.r): r.votes for r in chroma.offset_votes(chroma._keys(classes, "q", "q").withColumn("salt", F.lit(0)), every).collect()}
    keys = {i: [(a, b) for a, b in zip(c, c[chroma.GAP :], strict=False)] for i, c in rows}
    for a in keys:
        for b in keys:
            bars = {}
            for s, x in enumerate(keys[a]):
                for t, y in enumerate(keys[b]):
                    if x == y:
                        bars[t - s] = bars.get(t - s, 0) + 1
            if a != b:
                assert got.get((a, b), 0) == max(bars.values(), default=0)


def test_bit_errors_at_all_offsets():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 2**32, 23), rng.integers(0, 2**32, 31)
    wrong, over = chroma.bit_errors(x, y)
    for k, shift in enumerate(range(1 - len(x), len(y))):
        a, b = max(0, -shift), min(len(x), len(y) - shift)
        assert (over[k], wrong[k]) == (b - a, np.bitwise_count(x[a:b] ^ y[a + shift : b + shift]).sum())


def test_other_tokenizer_files(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["<unk>", "<end>", "Hello", "hello", "World", "world", ",", "it", "'", "s"]
    kept = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="<unk>"))
    kept.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "words.json")
    kept.save(path)
    texts = ["Hello World", "hello, world it's", None, "", "HELLO\nHello"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = new_dir(spark, "other")
    got = token_files.read_token_files(spark, folder, token_files.vocabulary_dtype(path), token_files.write_token_files(df, folder, path, 1)).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [kept.encode(x or "").ids + [1] for x in texts] and list(got[0].ids) == [2, 4, 1]
    assert token_files.fits_shortcut(P.path("word_bpe_49k.json")) and not token_files.fits_shortcut(path)
    assert isinstance(token_files._pieces(P.path("word_bpe_49k.json"), "<u2"), token_files.WordIds)


def test_cut_characters_by_token(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["😀 ünï 中文 ascii", "", "🤷🏽‍♀️ mixed é"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = bpe._token_table(path)
    assert table == {i: t for t, i in bpe.read_ranks(path).items()}
    for r in bpe.encode(df, path, P.PATTERN).collect():
        raw, at, cut = texts[r.doc_id].encode(), 0, 0
        for i in r.ids:
            ends = (at, at + len(table[i]))
            cut += any(k < len(raw) and raw[k] & 0xC0 == 0x80 for k in ends)
            at = ends[1]
        assert r.n_split == cut
    assert bpe.encode(df, path, P.PATTERN).agg(F.sum("n_split")).first()[0] > 0


def test_ten_benchmark_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    key = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in df.collect())
    assert key(wumanber.find_windows(docs, items, shard_bytes=size // 10)) == key(wumanber.find_windows(docs, items))


def test_joins_with_hot_keys(spark):
    rows = [(k % 7 if k % 3 else 0, k) for k in range(6000)] + [(None, -1), (99, -2)]
    asked = spark.createDataFrame(rows, "key long, v long")
    table = asked.where("key IS NOT NULL AND key <> 99").groupBy("key").agg(F.count("*").alias("weight"), F.sum("v").alias("s"))
    for how in ("inner", "left"):
        got = sorted(map(repr, joins.look_up(asked, table, ["key"], "weight", 6002, how).collect()))
        assert got == sorted(map(repr, asked.join(table.drop("weight"), ["key"], how).collect()))


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(5, k) for k in range(6, 3000)] + [(3000, 3001), (2999, 4000), (4000, 2)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {k: 2 for k in [*range(5, 3000), 4000, 2]} | {3000: 3000, 3001: 3000}


def test_penalty_is_chosen_on_rows_left_out():
    rng = np.random.default_rng(3)
    n, words = 400, 60
    marks = rng.random((n, words)) < 0.1
    grades = (marks[:, :3].any(1)).astype(np.int64)
    rows, cols = np.nonzero(marks)
    chosen = toxicity.choose_penalty(rows, cols, grades, words)
    assert chosen == min(toxicity.PENALTIES)
    noise = rng.integers(0, 2, n)
    assert toxicity.choose_penalty(rows, cols, noise, words) == max(toxicity.PENALTIES)
    assert toxicity.choose_penalty(rows, cols, np.zeros(n, np.int64), words, (0.5,)) == 0.5
