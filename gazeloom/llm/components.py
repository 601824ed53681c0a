"""Connected components by alternating large-star and small-star steps.

Edges stay distributed; each step is an aggregation to the smallest neighbour (with
partial sums, so hubs don't gather in a task) and a join back, in which hubs are
broadcast, and its result is written to the shared folder. Ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import look_up
from .storage import drop, stash


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Null ends, self loops and repeated edges have no effect; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now = stash(now, "edges")
    seen = _print(now)
    for _ in range(max_rounds if seen[0] else 0):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).select("u", F.least("u", "m").alias("m"), "weight")
        large = stash(look_up(both.where("v > u"), least, ["u"], "weight", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        drop(now)
        weighed = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        least = weighed.drop("weight")
        small = look_up(large, weighed, ["u"], "weight", 2 * seen[0])
        now = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "small-star")
        drop(large)
        after = _print(now)
        if after == seen:
            break
        seen = after
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    # the result reads the last table; drop(result) removes it
    out = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    out = out.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._gazeloom_path = now._gazeloom_path
    return out
