"""A training corpus from ``documents``: language, duplicates, benchmark leaks, personal data, tokens.

Each stage works on all that its predecessor kept, written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm import bpe, cpsjoin, feistel, langid, wumanber
from gazeloom.llm.queries import PII_KEY
from gazeloom.llm.storage import drop, stash


def _packed(docs: DataFrame) -> DataFrame:
    """``text`` and all other columns in one named ``row``, so that no name clashes with an operator's results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _unpacked(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose letters match no learned language, go; ``lang`` stays as given where known.

    Where no document has a language, nothing can be learned and all stay.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs
    marked = langid.predict(_packed(docs), model)
    kept = marked.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 0))
    return _unpacked(kept, docs, lang=F.coalesce("row.lang", "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates stays (five-word shingles, similarity 0.8); of rows that repeat its id and text all stay."""
    dropped = cpsjoin.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go.

    Null and empty texts have no words and stay, as does everything where the benchmark has no words; repeated rows are judged each.
    """
    found = wumanber.find_windows(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(~wumanber.contaminated()), docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their own format, equal ones the same in all documents; ``n_chars`` is counted anew.

    Null texts stay null (and so does ``n_chars``), texts without such values stay as they are.
    """
    return feistel.pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes; null counts as the empty text, which has no ids."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bpe.decode(coded.drop("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), as_text=False)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pseudonyms", pseudonyms),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        drop(before)  # each stage reads only the one before; the input itself is no stashed table
    return STAGES[-1][1](spark, docs, sf_dir)


#: Minwise trees, keyed permutations and merges have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None
