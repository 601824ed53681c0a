"""Queries over the driver's tables, one ``opN_<name>`` per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chroma, cpsjoin, divergence, feistel, langid, token_files, toxicity, trie, url_filter, wrappers, wumanber
from .storage import new_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, path = new_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")
    bases = token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, path, end_id=1)
    return token_files.read_token_files(spark, folder, token_files.vocabulary_dtype(path), bases, with_ids=False)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op4_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so each embedding is sounded as a recording of eight seconds."""
    sound = chroma.sonify(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    aligned = chroma.align(chroma.add_fingerprints(sound, "id", "pcm"), F.col("id") % 50 == 0)
    return aligned.withColumnRenamed("id", "vec_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels know two grades, not toxic and toxic; their quality says nothing about it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.predict(docs, model).drop("text")


def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(_table(spark, sf_dir, "conversations"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.near_duplicates(_table(spark, sf_dir, "documents"), words=3, threshold=85)


def op8_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = wumanber.find_windows(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        wumanber.contaminated().alias("contaminated"),
    )


#: Key of the queries; production passes its own.
PII_KEY = "public-demonstration-key"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is rebuilt with the beginning of another one, so that prefixes are shared."""
    return trie.trie(*trie.forked(trie.placed_turns(_table(spark, sf_dir, "conversations"))))


#: Fixed rules of the query.
URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled URL table is what the rules decide; the model carries it over to all other pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = pages.select("url", url_filter.rule_of(*url_filter.parts(F.col("url")), URL_RULES)[1].alias("verdict"))
    return url_filter.judge(pages, url_filter.fit(labelled), URL_RULES).drop("url")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_token_files, op3_language_id, op4_chroma_alignment, op5_toxicity, op6_chat_snapshots, op7_near_duplicates, op8_benchmark_windows, op9_pseudonyms, op10_main_text, op11_prefix_trie, op12_url_filter, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {"op6_chat_snapshots": chat.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_source_divergence": divergence.ORACLE}
