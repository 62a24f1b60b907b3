"""Alert rules: each is a query that gives rule, severity, dedupe_key and title; evaluate() unions and orders them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.aggregates import at_least

FIELDS = ("rule", "kind", "severity", "dedupe_key", "title")


def _alert(rows: DataFrame, rule: str, kind: str, severity: str, key: list[Column], title: Column) -> DataFrame:
    parts = [F.coalesce(k.cast("string"), F.lit("never")) for k in key]
    return rows.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.concat_ws(":", F.lit(rule), *parts).alias("dedupe_key"), title.alias("title"))


def run_failed(runs: DataFrame) -> DataFrame:
    """R1."""
    return _alert(runs.where("status = 'failed' and alerted_at is null"), "run_failed", "system", "high", [F.col("id")], F.concat(F.lit("run failed: "), F.col("id").cast("string")))


def source_down(states: DataFrame, n: int) -> DataFrame:
    """R2: the episode is named by the last success, so a recovery ends it."""
    bad = states.where((F.col("consecutive_failures") >= n) & ~F.coalesce("disabled", F.lit(False)))
    return _alert(bad, "source_down", "system", "high", [F.col("source_id"), F.col("last_success_at")], F.concat("source_id", F.lit(" is down")))


def budget_exceeded(spend: DataFrame) -> DataFrame:
    """Scopes (a run, a month) whose spend is over their ceiling."""
    return _alert(spend.where("spent > ceiling"), "budget_exceeded", "system", "high", [F.col("scope"), F.col("scope_key")], F.concat("scope", F.lit(" over budget")))


def drift(snapshots: DataFrame, floor: float, version: str) -> DataFrame:
    """The newest snapshot is under the floor; the episode is named by the version and the last good one."""
    ends = snapshots.agg(F.max_by(F.struct("id", "f1"), "id").alias("last"), F.max(F.when(F.col("f1") >= floor, F.col("id"))).alias("good"))
    return _alert(ends.where(F.col("last.f1") < floor), "drift", "system", "high", [F.lit(version), F.lit("since"), F.coalesce(F.col("good").cast("string"), F.lit("since-first-measurement"))], F.concat(F.lit("agreement fell to "), F.round("last.f1", 3).cast("string")))


def drift_unavailable(snapshots: DataFrame) -> DataFrame:
    """Nothing was compared, and there were errors."""
    return _alert(snapshots.where("compared = 0 and errors > 0"), "drift_unavailable", "system", "medium", [F.col("id")], F.lit("drift could not be measured"))


def high_band(items: DataFrame, floor: str, since: Column) -> DataFrame:
    """Recent items of a band at or over the floor."""
    good = items.where((F.col("published_on") >= since) & at_least(F.col("band"), F.lit(floor)))
    return _alert(good, "high_band_item", "item", "medium", [F.col("url")], F.col("title"))


def holding_impact(connections: DataFrame, articles: DataFrame, holdings: DataFrame, least: float, since: Column) -> DataFrame:
    """One alert per article and holding, for its strongest connection."""
    strong = connections.where(F.col("strength") >= least).join(articles.where(F.col("published_on") >= since), "article").join(holdings.select("isin", F.col("name").alias("holding")), "isin")
    best = strong.groupBy("url", "isin").agg(F.max_by(F.struct("title", "holding", "strength"), F.struct("strength", "via")).alias("b"))
    return _alert(best.orderBy(F.desc("b.strength"), "url", "isin"), "holding_impact", "item", "medium", [F.col("url"), F.col("isin")], F.concat("b.holding", F.lit(": "), F.col("b.title")))


def dedupe_unavailable(stats: DataFrame) -> DataFrame:
    """No row had a vector though there were rows; an error and plain absence are told apart."""
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("grouping failed: "), "error")).otherwise("no vectors")
    return _alert(stats.where("rows > 0 and coverage = 0"), "dedupe_unavailable", "system", "medium", [F.col("run")], why)


def extraction_downgraded(rows: DataFrame) -> DataFrame:
    """Laboratories whose texts came another way than configured."""
    off = rows.where("configured <> actual").groupBy("lab", "configured", "actual").agg(F.count(F.lit(1)).alias("n"))
    return _alert(off, "extraction_downgraded", "system", "low", [F.col("lab"), F.col("configured"), F.col("actual")], F.concat_ws(" ", "lab", F.lit("fell back to"), "actual"))


def filter_unavailable(runs: DataFrame) -> DataFrame:
    """As many errors as judgements."""
    return _alert(runs.where("judged > 0 and errors >= judged"), "repo_filter_unavailable", "system", "medium", [F.col("run")], F.lit("the relevance filter failed"))


def watermark_stalled(states: DataFrame, days: int) -> DataFrame:
    """R11, I12."""
    off = states.where(F.datediff("last_success_at", "watermark") >= days)
    return _alert(off, "watermark_stalled", "system", "medium", [F.col("source_id"), F.col("watermark")], F.concat("source_id", F.lit(" succeeds but finds nothing")))


def evaluate(rules: list[DataFrame]) -> DataFrame:
    """All candidates, system ones first, each key once."""
    rows = reduce(lambda a, b: a.unionByName(b), rules).dropDuplicates(["dedupe_key"])
    return rows.orderBy(F.when(F.col("kind") == "system", 0).otherwise(1), "rule", "dedupe_key")
