"""Feeds, budgets and carried-forward rows behind the read endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.topk import clamp, newest_first


def shown_routes(connections: DataFrame, hidden: list[str]) -> DataFrame:
    """Connections by the routes that aren't hidden."""
    return connections.where(~F.col("route").isin(*hidden))


def investment_cut(items: DataFrame, kind: str) -> DataFrame:
    """Only the investment cut leaves out items of no score."""
    return items.where("score > 0") if kind == "investment" else items


def listing_fields(listing: DataFrame) -> DataFrame:
    """A repository's listing with defaults."""
    defaults = {"stars": 0, "description": "", "archived": False, "fork": False}
    return listing.select("org", "repo", "pushed_at", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()])


def on_shared_ids(gold: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """Both sides' rows of the ids that both have."""
    side = lambda df, s: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(s))
    return side(gold, "gold").join(side(run, "run"), key)


def carried_forward(responses: DataFrame, articles: DataFrame, version: str, to: str, kind: str) -> DataFrame:
    """One version's answers of a kind of article under the next version, where that has none."""
    old = responses.where(F.col("prompt_version") == version).join(articles.where(F.col("kind") == kind).select("url"), "url", "left_semi")
    have = responses.where(F.col("prompt_version") == to).select("url")
    return old.join(have, "url", "left_anti").withColumn("prompt_version", F.lit(to))


def month_to_date(sources: DataFrame, runs: DataFrame, month_start: Column) -> DataFrame:
    """What runs of a month spent; 0 without any."""
    inside = runs.where(F.col("started_at") >= month_start).select("run")
    return sources.join(inside, "run", "left_semi").agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("spent"))


def allocation(users: DataFrame, remaining: int, ceiling: int, floor: int, whole: int) -> DataFrame:
    """an unknown projection gets a full page, which is expected to cost nothing; nothing is asked of a projection of 0; small
    ones are taken whole; the others share what is left equally, between floor and ceiling, and get nothing if nothing is left.

    users: user, projected (null if unknown). Totals are a one-row aggregate."""
    known, most = F.col("projected"), min(ceiling, 100)
    small = F.greatest(F.lit(5), F.least(known, F.lit(most)))
    rows = users.where("projected is null or projected <> 0").withColumn("_small", F.when(known <= whole, small))
    sums = rows.agg((F.lit(remaining) - F.coalesce(F.sum("_small"), F.lit(0))).alias("_budget"), F.count_if(known > whole).alias("_k"))
    equal = F.floor(F.col("_budget") / F.col("_k"))
    each = F.greatest(F.lit(floor), F.least(F.lit(most), equal))
    each = F.when(each * F.col("_k") > F.col("_budget"), F.greatest(F.lit(5), equal)).otherwise(each)
    share = F.when(F.col("_budget") > 0, F.greatest(F.lit(5), F.least(each, known)))
    cap = F.when(known.isNull(), most).otherwise(F.coalesce("_small", share))
    return rows.crossJoin(F.broadcast(sums)).withColumn("cap", cap.cast("long")).where("cap is not null").drop("_small", "_budget", "_k")


def feed(rows: DataFrame, kind: str | None, order: list[str], limit: int, most: int = 200) -> DataFrame:
    """Q2, Q4, Q5, O2, O3: the newest rows of a kind, at most a clamped number."""
    return newest_first(rows.where(F.col("kind") == kind) if kind else rows, order, clamp(limit, most))


def drift_history(snapshots: DataFrame, version: str, limit: int) -> DataFrame:
    """The last snapshots of a version, the oldest first."""
    return newest_first(snapshots.where(F.col("prompt_version") == version), ["id"], clamp(limit, 100), oldest_shown_first=True)


def described_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with their seconds so far; the newest running one is current."""
    seconds = F.unix_timestamp(F.coalesce("finished_at", now)) - F.unix_timestamp("started_at")
    newest = F.max(F.when(F.col("status") == "running", F.col("id"))).over(Window.partitionBy())
    return runs.withColumn("seconds", seconds).withColumn("is_current", F.coalesce(F.col("id") == newest, F.lit(False)))


def register_view(people: DataFrame, evidence: DataFrame, query: str, most: int = 50) -> DataFrame:
    """People whose name, or whose evidence's address, holds the query."""
    needle = F.lit(query.strip().lower())
    by_name = people.where(F.contains(F.lower("name"), needle)).select("id")
    by_link = evidence.where(F.contains(F.lower("ref_url"), needle)).select(F.col("person_id").alias("id"))
    hits = by_name.union(by_link).distinct()
    return (people.join(hits, "id", "left_semi") if query.strip() else people.limit(0)).orderBy("id").limit(most)
