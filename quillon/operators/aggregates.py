"""Scores, roll-ups, counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.maths import GATE, LEVELS, lookup

#: Floors from the top; the first that a score reaches names its band.
BANDS = (("critical", 75.0), ("high", 50.0), ("medium", 25.0), ("low", 0.0))


def band_of(score: Column, bands=BANDS) -> Column:
    """The first band, in the order given, whose floor the score reaches."""
    out = F
    for label, floor in bands:
        out = out.when(score >= floor, label)
    return out


def band_rank(band: Column, unknown: int, bands=BANDS) -> Column:
    """P5: 0 for the lowest band upwards."""
    out = F
    for i, (label, _) in enumerate(reversed(bands)):
        out = out.when(band == label, i)
    return out.otherwise(unknown)


def at_least(band: Column, floor: Column, bands=BANDS) -> Column:
    """P5: an unknown band is under all, an unknown floor over all."""
    return band_rank(band, -1, bands) >= band_rank(floor, 99, bands)


def event_scores(items: DataFrame, tags: DataFrame, key: str, event_weight: Column, most: float = 5.0) -> DataFrame:
    """A5: 100 * (event weight / its maximum) * (strongest tag / its maximum); items without tags score 0.

    tags: key, magnitude, confidence."""
    strength = lookup(LEVELS, F.col("magnitude")) * lookup(GATE, F.col("confidence"))
    best = tags.groupBy(key).agg(F.max(strength).alias("_best"))
    out = items.join(best, key, "left")
    return out.withColumn("score", F.round(100.0 * (event_weight / most) * (F.coalesce("_best", F.lit(0.0)) / 3.0), 1)).drop("_best")


def both_scores(items: DataFrame, tags: DataFrame, key: str, event_weight: Column, actions: dict[str, float], most: float = 5.0) -> DataFrame:
    """A5 and A6 in one pass over the tags: score and ai_score."""
    strength = lookup(LEVELS, F.col("magnitude")) * lookup(GATE, F.col("confidence"))
    impact = lookup(LEVELS, F.col("impact")) * lookup(GATE, F.col("confidence"))
    best = tags.groupBy(key).agg(F.max(strength).alias("_best"), F.max(lookup(actions, F.col("action"))).alias("_a"), F.max(impact).alias("_s"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = items.join(best, key, "left").withColumn("score", F.round(100.0 * (event_weight / most) * (zero("_best") / 3.0), 1))
    return out.withColumn("ai_score", F.round(100.0 * (zero("_a") / max(actions.values())) * (zero("_s") / 3.0), 1)).drop("_best", "_a", "_s")


def practice_scores(items: DataFrame, tags: DataFrame, key: str, actions: dict[str, float]) -> DataFrame:
    """The greatest action weight and the greatest impact * confidence, each by itself."""
    top = max(actions.values())
    best = tags.groupBy(key).agg(F.max(lookup(actions, F.col("action"))).alias("_a"), F.max(lookup(LEVELS, F.col("impact")) * lookup(GATE, F.col("confidence"))).alias("_s"))
    out = items.join(best, key, "left")
    score = 100.0 * (F.coalesce("_a", F.lit(0.0)) / top) * (F.coalesce("_s", F.lit(0.0)) / 3.0)
    return out.withColumn("ai_score", F.round(score, 1)).drop("_a", "_s")


# Tiers that assert employment.
EMPLOYMENT_TIERS = ("confirmed", "confirmed_org_wide")


def watermarks(rows: DataFrame, group: str, at: str) -> DataFrame:
    """A1."""
    return rows.groupBy(group).agg(F.max(at).alias("newest"), F.count(F.lit(1)).alias("n")).orderBy(group)


def register_overview(people: DataFrame, evidence: DataFrame) -> DataFrame:
    """A3: people per laboratory by source, and those with evidence of employment; the largest first."""
    has = evidence.where(F.col("tier").isin(*EMPLOYMENT_TIERS)).select(F.col("person_id").alias("id"), F.lit(True).alias("has")).distinct()
    rows = people.join(has, "id", "left")
    counts = [F.count_if(F.col("source_kind") == k).alias(k) for k in ("paper", "github")]
    return rows.groupBy("lab").agg(*counts, F.count_if(F.col("has")).alias("evidenced"), F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "lab")


def tier_counts(evidence: DataFrame) -> DataFrame:
    """A2: evidence rows by tier, the most frequent first."""
    return evidence.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tier")


def moves(people: DataFrame, evidence: DataFrame, gated_kind: str = "github") -> DataFrame:
    """Names of one kind at two laboratories or more; of the gated kind only if every side has
    evidence of employment.

    People: id, kind, name, lab, first_seen, last_seen. Days between may be negative, where stays overlap."""
    tiers = evidence.groupBy(F.col("person_id").alias("id")).agg(F.sort_array(F.collect_set("tier")).alias("tiers"), F.slice(F.sort_array(F.collect_set("ref_url")), 1, 5).alias("sources"))
    rows = people.join(tiers, "id", "left").withColumn("evidenced", F.coalesce(F.arrays_overlap("tiers", F.array(*[F.lit(t) for t in EMPLOYMENT_TIERS])), F.lit(False)))
    side = F.struct("first_seen", "lab", "last_seen", "evidenced", "tiers", "sources")
    out = rows.groupBy("kind", "name").agg(F.sort_array(F.collect_list(side)).alias("sides"), F.countDistinct("lab").alias("labs"), F.bool_and("evidenced").alias("all_evidenced"))
    out = out.where("labs >= 2").where((F.col("kind") != gated_kind) | F.col("all_evidenced"))
    first, last = F.get("sides", F.lit(0)), F.get("sides", F.size("sides") - 1)
    return out.withColumn("direction", F.concat(first["lab"], F.lit(" -> "), last["lab"])).withColumn("gap_days", F.datediff(last["first_seen"], first["last_seen"]))


def total(rows: DataFrame, value: str, name: str) -> DataFrame:
    """A4: a sum that is 0 over nothing."""
    return rows.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))


def holdings_line(connections: DataFrame, key: str, most: int = 3) -> DataFrame:
    """An item's holdings by strength: the first few named, the others counted."""
    best = connections.groupBy(key, "isin").agg(F.max("strength").alias("s"))
    packed = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), F.col("isin"))))
    out = best.groupBy(key).agg(packed.alias("all"))
    return out.select(key, F.transform(F.slice("all", 1, most), lambda x: x["isin"]).alias("named"), F.greatest(F.size("all") - most, F.lit(0)).alias("others"))


def map_of_counts(rows: DataFrame, key: str, member: str, at: str) -> DataFrame:
    """Per key the total, a map of counts by member, and the first and last time; counted in two levels."""
    per = rows.groupBy(key, member).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(member).alias("key"), F.col("n").alias("value"))))
    return per.groupBy(key).agg(F.sum("n").alias("total"), F.map_from_entries(entries).alias("counts"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def employment(corp: Column, shared_domain: Column, vendor: Column, handle: Column) -> Column:
    """Any commit from a corporate address confirms, one from a domain that a parent shares org-wide; else vendor, else the
    work handle, else unknown."""
    return F.when(corp > 0, F.when(shared_domain, "confirmed_org_wide").otherwise("confirmed")).when(vendor > 0, "vendor").when(handle, "handle").otherwise("unknown")


def retiered(tier: Column, company_matches: Column, profile_missing: Column) -> Column:
    """P20: a confirmed tier stands; then the company on the profile; a handle stands; a missing profile is a deleted account."""
    return F.when(tier.isin(*EMPLOYMENT_TIERS), tier).when(company_matches, "profile").when(tier == "handle", tier).when(profile_missing, "deleted").otherwise(tier)


def pivot_counts(rows: DataFrame, group: str, by: str, values: list[str]) -> DataFrame:
    """A zero-filled count for each of the fixed values, without a pivot's extra pass."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values])


def bylines(rows: DataFrame) -> DataFrame:
    """Per name the appearances, first and last author where order means something, and sets.

    rows: name, article, position, n_authors, ordered, is_core, affiliations, day."""
    one = F.col("ordered") & (F.col("position") == 1)
    end = F.col("ordered") & (F.col("position") == F.col("n_authors"))
    return rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("appearances"), F.count_if(one).alias("first_author"), F.count_if(end).alias("last_author"), F.bool_or("is_core").alias("core"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("affiliations")))).alias("affiliations"), F.countDistinct("article").alias("articles"),
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
    )


#: An institution whose lower-cased name holds one of them is a tracked lab itself.
LAB_WORDS = ("anthropic", "openai", "deepmind", "google", "meta", "facebook", "fair", "mistral", "deepseek", "xai")


def survey_counts(announcements: DataFrame, people: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Announcements per lab, affiliations per lab and name, and the commonest institutions that are no lab.

    announcements: lab; people: lab, affiliations (array), a row per person in the lab's register. Ties go by name."""
    by_lab = announcements.groupBy("lab").agg(F.count(F.lit(1)).alias("n"))
    counts = people.select("lab", F.explode("affiliations").alias("name")).groupBy("lab", "name").agg(F.count(F.lit(1)).alias("n"))
    outside = counts.where(~F.lower("name").rlike("|".join(LAB_WORDS))).groupBy("name").agg(F.sum("n").alias("n"))
    return by_lab, counts, outside.orderBy(F.desc("n"), "name").limit(top)


def outside_organisations(rows: DataFrame) -> DataFrame:
    """Rows name, article, fellow, organisations (array)."""
    each = rows.select("name", "article", "fellow", F.explode("organisations").alias("organisation"))
    out = each.groupBy("organisation").agg(F.countDistinct("name").alias("people"), F.countDistinct("article").alias("articles"), F.bool_or("fellow").alias("fellowship"))
    return out.orderBy(F.desc("articles"), F.desc("people"), "organisation")


def shares(rows: DataFrame, keys: list[str], value: str, within: list[str] = ()) -> DataFrame:
    """Sums by key and their share of all, or of their group, in percent. The totals are a second, small aggregate."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("total"))
    if within:
        return sums.withColumn("pct", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy(*within)), 4))
    whole = sums.agg(F.sum("total").alias("_all"))
    return sums.crossJoin(F.broadcast(whole)).withColumn("pct", F.round(100.0 * F.col("total") / F.col("_all"), 4)).drop("_all")


def concentration(sums: DataFrame, value: str, n: int) -> DataFrame:
    """The share of the n largest."""
    top = sums.orderBy(F.desc(value)).limit(n).agg(F.sum(value).alias("top"))
    return sums.agg(F.sum(value).alias("all")).crossJoin(F.broadcast(top)).select(F.round(100.0 * F.col("top") / F.col("all"), 4).alias("pct"))


def limit_rules(rows: DataFrame, group: str, name: str, pct: str) -> DataFrame:
    """The largest position, how many over 5 and 10 percent, and what those over 5 sum to."""
    p = F.col(pct)
    return rows.groupBy(group).agg(
        F.max(p).alias("max_pct"), F.max_by(name, F.struct(p, F.col(name))).alias("top_name"), F.count_if(p > 5).alias("n_over_5"),
        F.round(F.coalesce(F.sum(F.when(p > 5, p)), F.lit(0.0)), 4).alias("sum_over_5"), F.count_if(p > 10).alias("n_over_10"),
    )


def apportion(groups: DataFrame, key: str, size: str, seats: int) -> DataFrame:
    """Largest remainders: whole parts of the shares, then one more for the largest rests. One row per group."""
    every = Window.partitionBy()
    exact = F.col(size) * F.lit(float(seats)) / F.sum(size).over(every)
    out = groups.withColumn("_x", exact).withColumn("_w", F.floor("_x"))
    rest = Window.orderBy(F.desc(F.col("_x") - F.col("_w")), key)
    missing = F.lit(seats) - F.sum("_w").over(every)
    return out.withColumn("seats", (F.col("_w") + (F.row_number().over(rest) <= missing).cast("int")).cast("long")).drop("_x", "_w")


def run_stats(runs: DataFrame) -> DataFrame:
    """A run's sources by status, the failed ones by name, and the cost."""
    return runs.groupBy("run").agg(
        F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.col("source")))).alias("sources_failed"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"),
    )


def disagreement(rows: DataFrame, score: str, flag: str) -> DataFrame:
    """Scored but not flagged, flagged but not scored, and agreeing rows."""
    s, f = F.col(score) > 0, F.col(flag)
    return rows.agg(F.count_if(s & ~f).alias("scored_only"), F.count_if(~s & f).alias("flagged_only"), F.count_if(s == f).alias("agree"))
