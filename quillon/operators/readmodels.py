"""Nested read models and what a client filters, sorts and counts in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import humanise
from quillon.operators.joins import nested


def connection_label(route: Column, via: Column) -> Column:
    """P18."""
    named = F.concat(F.lit("Named: "), F.split_part(via, F.lit(":"), F.lit(2)))
    return F.when(route == "named", named).when(route == "exposure", F.concat(F.lit("Exposure to "), F.split_part(via, F.lit(":"), F.lit(1)))).otherwise(humanise(via))


def basis(tag: str = "tag") -> Column:
    """Q8: why an item scores: its strongest tag's parts as a struct, null without one."""
    t = F.col(tag)
    return F.when(t.isNotNull(), F.struct(t["mechanism"].alias("mechanism"), t["magnitude"].alias("magnitude"), t["confidence"].alias("confidence"), t["quote"].alias("quote")))


def items(articles: DataFrame, tags: DataFrame, connections: DataFrame, groups: DataFrame, labs: DataFrame) -> DataFrame:
    """Articles with labels, nested tags and connections, group and rank numbers."""
    lines = connections.withColumn("label", connection_label(F.col("route"), F.col("via")))
    out = nested(articles, tags, "article", ["ordinal", "mechanism", "magnitude", "confidence"], "tags", ["ordinal"])
    out = nested(out, lines, "article", ["strength", "isin", "route", "via", "direction", "label"], "connections", ["isin", "route", "via"])
    out = out.join(groups.select("article", "group_id", "size"), "article", "left").join(labs.select("lab", F.col("label").alias("lab_label")), "lab", "left")
    best = F.round(100 * F.coalesce(F.array_max(F.transform("connections", lambda c: c["strength"])), F.lit(0.0)), 0)
    out = out.withColumn("lab_label", F.coalesce("lab_label", "lab")).withColumn("holding_score", best)
    return out.withColumn("rank_value", F.greatest("score", "holding_score")).withColumn("rank_min", F.least("score", "holding_score"))


def visible(rows: DataFrame, band: str | None = None, lab: str | None = None, kind: str | None = None, isin: str | None = None) -> DataFrame:
    """Facet filters and the order of the list."""
    for column, value in (("band", band), ("lab", lab), ("doc_type", kind)):
        rows = rows.where(F.col(column) == value) if value else rows
    rows = rows.where(F.exists("connections", lambda c: c["isin"] == isin)) if isin else rows
    return rows.where("rank_value > 0").orderBy(F.desc("rank_value"), F.desc("rank_min"), F.desc("published_on"), "article")


def facets(rows: DataFrame) -> DataFrame:
    """Options with counts: laboratories, and holdings once per article."""
    labs = rows.groupBy(F.col("lab").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("lab"))
    held = rows.select("article", F.explode(F.array_distinct(F.transform("connections", lambda c: c["isin"]))).alias("value"))
    held = held.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("holding"))
    return labs.unionByName(held).orderBy("facet", F.desc("n"), "value")


def digest(rows: DataFrame, group: str, passes: Column, start: Column, end: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """A window's items, one per group, capped by merit and shown by date; and the statistics.

    rows: published_on, rank_value, rank_min, article. Groups without a passing member count as considered and collapsed."""
    from quillon.operators.topk import capped_digest
    from quillon.operators.windows import first_passing

    inside = rows.where((F.col("published_on") > start) & (F.col("published_on") <= end)).withColumn("_ok", F.coalesce(passes, F.lit(False)))
    best = first_passing(inside, group, F.col("_ok"), "rank_value", "published_on", "article")
    merit = [F.desc("rank_value"), F.desc("rank_min"), F.desc("published_on"), F.asc("article")]
    shown = capped_digest(best, merit, [F.desc("published_on"), F.desc("rank_value"), F.asc("article")], most)
    per = inside.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.bool_or("_ok").alias("ok"))
    stats = per.agg(F.count(F.lit(1)).alias("considered"), F.count_if("ok").alias("matched_rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collapsed"))
    stats = stats.withColumn("surfaced", F.least("matched_rule", F.lit(most))).withColumn("suppressed", F.col("considered") - F.col("surfaced"))
    return shown.drop("_ok"), stats


def search(rows: DataFrame, key: str, columns: list[str], query: str, most: int) -> DataFrame:
    """Rows in one of whose columns the query stands, in either case; nothing for a blank query."""
    if not query.strip():
        return rows.limit(0)
    needle = F.lit(query.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    return rows.where(hit).orderBy(key).limit(most)


def health(counts: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    first, *rest = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    for one in rest:
        first = first.unionByName(one)
    return first
