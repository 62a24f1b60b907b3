"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.scratch import cut, drop

#: Edges that a file of a round's table holds.
PER_FILE = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(node, root) with root the least node of the component, by alternating large-star and small-star rounds.

    Least neighbours come from partial aggregates, so a hub costs a row per task; each round's edges are a table in
    the shared folder, and the rounds grow with the logarithm of the largest component."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(pairs.where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # No round makes more edges than it read.
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", -(-mark[0] // PER_FILE) or 1)
        drop(now)
        was, mark, now = mark, _mark(new), new
        if mark == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h), F.bit_xor(F.xxhash64("v", "u"))).first())
