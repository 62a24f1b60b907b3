"""Predicates and projections with a rule of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import substance

# Accounts that are automation.
BOTS = (
    "actions-user github-actions stainless-bot stainless-app dependabot renovate claude web-flow copybara-github copilot speakeasybot maiengineering goreleaserbot"
).split()


def is_bot(login: Column) -> Column:
    """P12."""
    return F.lower(login).isin(*BOTS) | login.rlike(r"(?i)(\[bot\]$|^bot-|-bot$|^stainless)")


def is_mirror(description: Column) -> Column:
    """P11."""
    return F.coalesce(description.rlike(r"(?i)\bmirror of\b"), F.lit(False))


def post_verdict(text: Column, links: Column, min_chars: int) -> Column:
    """Why a post goes, or null."""
    core = substance(text)
    return F.when((F.size(links) > 0) & (core == ""), "link only: no text of its own").when(
        F.length(core) < min_chars, F.concat(F.lit(f"under {min_chars} characters of substance ("), F.length(core).cast("string"), F.lit(")"))
    )


def with_defaults(rows: DataFrame, payload: str, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """Fields of a JSON payload with types and defaults."""
    return rows.select("*", *[F.coalesce(F.get_json_object(payload, f"$.{name}").try_cast(kind), F.lit(default).cast(kind)).alias(name) for name, (kind, default) in fields.items()])


def keep_first_seen(basis: Column, new: Column, old: Column) -> Column:
    """A stored date stays where the new one only says when it was first seen."""
    return F.when((basis == "first_seen") & old.isNotNull(), old).otherwise(new)


def mapped(values: dict[str, str], key: Column, default: str) -> Column:
    """P17."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def worth_fetching(tier: Column, commits: Column, tiers: list[str], least: int) -> Column:
    """P19."""
    return tier.isin(*tiers) | (commits >= least)


def trimmed_history(commits: Column, since: Column) -> Column:
    """The commits since a day, and how many."""
    kept = F.filter(commits, lambda c: c["date"] >= since)
    return F.struct(kept.alias("commits"), F.size(kept).alias("n"))


def text_fields(kind: Column, title: Column, text: Column) -> Column:
    """Releases are searched in their text only."""
    return F.when(kind == "github_release", F.array(text)).otherwise(F.array(title, text))


def channels(labs: DataFrame) -> DataFrame:
    """A laboratory's main channel and its further ones, which override its settings; disabled ones go.

    labs: lab, method, url, enabled, also (array of structs of method, url, enabled)."""
    main = F.array(F.struct("method", "url", "enabled"))
    each = labs.select("lab", F.col("method").alias("m"), F.col("url").alias("u"), F.explode(F.concat(main, F.coalesce("also", F.array().cast(main_type(labs))))).alias("c"))
    return each.select("lab", F.coalesce("c.method", "m").alias("method"), F.coalesce("c.url", "u").alias("url"), F.coalesce("c.enabled", F.lit(True)).alias("enabled")).where("enabled").drop("enabled")


def main_type(labs: DataFrame):
    return labs.schema["also"].dataType


def newest_per_url(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each page that is no picture."""
    pages = snapshots.where(~F.col("url").rlike(r"(?i)\.(png|jpe?g|gif|svg|webp|ico)$"))
    return pages.groupBy("url").agg(F.max("timestamp").alias("timestamp"))


def prefixed(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """P10: rows whose value starts with a prefix, which a scan takes as a range."""
    return rows.where(F.col(column).startswith(prefix))
