"""Frequent sequential patterns of AoI sequences with pyspark.ml's prefix-projected search."""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequential_patterns(sequences: DataFrame, share: float = 0.5, longest: int = 10, top: int | None = 50) -> DataFrame:
    """(pattern, len, support, share): subsequences, gaps allowed, of at least ``share`` of the recordings.

    ``sequences`` has (recording_id, k, aoi) with runs collapsed; null AoIs are left out.
    At most ``longest`` symbols; the ``top`` patterns by support, length and symbols, all
    descending (None: all). No recordings give no rows.
    """
    rows = sequences.where("aoi IS NOT NULL").groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("k", "aoi"))).alias("s"))
    packed = rows.select(F.transform("s.aoi", lambda a: F.array(a)).alias("sequence")).persist()
    total = packed.count()
    if not total:
        packed.unpersist()
        return sequences.sparkSession.createDataFrame([], "pattern string, len int, support long, share double")
    found = PrefixSpan(minSupport=share, maxPatternLength=longest).findFrequentSequentialPatterns(packed)
    packed.unpersist()
    out = found.select(F.array_join(F.flatten("sequence"), ",").alias("pattern"), F.size("sequence").alias("len"), F.col("freq").alias("support"), (F.col("freq") / F.lit(float(total))).alias("share"))
    return out if top is None else out.orderBy(F.desc("support"), F.desc("len"), F.desc("pattern")).limit(top)
