"""Orders, caps and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_digest(rows: DataFrame, merit: list[Column], shown: list[Column], most: int) -> DataFrame:
    """O1: the best by merit, then shown in another order. Two steps: the cap must not see the second order."""
    return rows.orderBy(*merit).limit(most).orderBy(*shown)


def clamp(limit: int, most: int) -> int:
    """O2."""
    return min(max(limit, 1), most)


def accepted_top(rows: DataFrame, accept: Column, order: list[Column], most: int) -> DataFrame:
    """The first rows in an order that a predicate accepts."""
    return rows.where(accept).orderBy(*order).limit(most)


def newest_first(rows: DataFrame, order: list[str], most: int, oldest_shown_first: bool = False) -> DataFrame:
    """The last rows; shown oldest first if wanted."""
    top = rows.orderBy(*[F.desc(c) for c in order]).limit(most)
    return top.orderBy(*order) if oldest_shown_first else top


def delivered(rows: DataFrame, order: list[Column], cap: int, group: list[str] = ()) -> DataFrame:
    """The first cap rows are delivered, the others suppressed with a reason."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    out = rows.withColumn("_n", n).withColumn("status", F.when(F.col("_n") <= cap, "delivered").otherwise("suppressed"))
    return out.withColumn("reason", F.when(F.col("_n") > cap, F.lit(f"over the cap of {cap}"))).drop("_n")


def capped_by_cursor(rows: DataFrame, group: str, order: list[str], has_cursor: Column, cap: int) -> DataFrame:
    """With a cursor the oldest rows of each group, so that none is skipped for good, without one the newest;
    and how many were left out."""
    up = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    sizes = rows.groupBy(group).agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("truncated"))
    out = rows.withColumn("_up", up).withColumn("_down", down)
    return out.where(F.when(has_cursor, F.col("_up")).otherwise(F.col("_down")) <= cap).drop("_up", "_down").join(sizes, group)


def severity_order(severity: Column, first: str = "system") -> Column:
    """The most severe kind ahead."""
    return F.when(severity == first, 0).otherwise(1)


def movers(rows: DataFrame, delta: str, key: str, n: int) -> DataFrame:
    """The largest gains and losses."""
    up = rows.where(F.col(delta) > 0).orderBy(F.desc(delta), key).limit(n).withColumn("way", F.lit("up"))
    return up.unionByName(rows.where(F.col(delta) < 0).orderBy(F.asc(delta), key).limit(n).withColumn("way", F.lit("down")))


def preferred_first(values: Column, preferred: Column, most: int) -> Column:
    """An array's first few, the preferred value ahead if it is there."""
    return F.slice(F.concat(F.filter(values, lambda v: v == preferred), F.filter(values, lambda v: v != preferred)), 1, most)


def groups_by_strongest(rows: DataFrame, group: str, strength: str) -> DataFrame:
    """Groups by their strongest member."""
    return rows.groupBy(group).agg(F.max(strength).alias("strongest"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("strongest"), group)


def stars(repos: DataFrame, least: int) -> DataFrame:
    """Repositories that aren't mirrors and have enough stars, the most first."""
    mirror = F.coalesce(F.col("description").rlike(r"(?i)\bmirror of\b"), F.lit(False))
    return repos.where(~mirror & (F.col("stars") >= least)).orderBy(F.desc("stars"), "repo")


def hash_sample(rows: DataFrame, key: str, strata: list[str], quota: int, seed: str) -> DataFrame:
    """A fixed number per stratum in the order of a digest; reruns agree."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_n")


def spread_sample(rows: DataFrame, key: str, group: str, kind: str, length: str, quota: int) -> DataFrame:
    """Round-robin over kinds within a group, the longest first, until the group's quota is full."""
    turn = F.row_number().over(Window.partitionBy(group, kind).orderBy(F.desc(length), key))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("turn", kind, key))
    return rows.withColumn("turn", turn).withColumn("nth", nth).where(F.col("nth") <= quota)


def tercile_sample(rows: DataFrame, key: str, value: str, each: int, seed: str) -> DataFrame:
    """Thirds by value, by two cut points from a bounded quantile sketch instead of one global sort."""
    cuts = rows.agg(F.percentile_approx(value, [1 / 3, 2 / 3], 10_000).alias("c"))
    third = F.when(F.col(value) <= F.col("c")[0], 1).when(F.col(value) <= F.col("c")[1], 2).otherwise(3)
    return hash_sample(rows.crossJoin(F.broadcast(cuts)).withColumn("third", third).drop("c"), key, ["third"], each, seed)
