"""Connected components of edges, by alternating large-star and small-star steps on DataFrames.

Each round writes its edges in the shared scratch folder, so lineage stays short and a lost executor costs a
round at most. Nothing but a count and a checksum of the edges comes to the driver. A node with very many
neighbours is a key of minima, which combine before the shuffle, and of joins whose two sides are shuffled for
the join alone, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, discard, settle

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node it can reach."""
    now = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")), "u")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        old, now = now, after
        discard(old)
        if (changed := _state(now)) == state:
            break
        state = changed
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
