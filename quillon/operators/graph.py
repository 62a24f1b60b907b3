"""Entities and graphs: components, alias chains, duplicate groups, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.maths import dot, normalised
from quillon.functions.text import normalised_title
from quillon.operators.components import components
from quillon.operators.joins import band_pairs
from quillon.scratch import cut, drop

#: Evidence from strongest to weakest.
METHOD_RANK = ("exact", "train", "gated", "adjudicated", "single")


def collapse_chains(links: DataFrame, alias: str = "alias", target: str = "target", max_rounds: int = 40) -> DataFrame:
    """Every alias to the end of its chain, by pointer jumping: each round doubles the reach."""
    now = cut(links.select(F.col(alias).alias("alias"), F.col(target).alias("target")), "chains")
    for _ in range(max_rounds):
        ahead = now.select(F.col("alias").alias("t"), F.col("target").alias("next"))
        step = now.join(ahead, F.col("target") == F.col("t"), "left")
        new = cut(step.select("alias", F.coalesce(F.when(F.col("next") != F.col("alias"), F.col("next")), F.col("target")).alias("target"), F.col("next").isNotNull().alias("moved")), "chains")
        moved = new.where("moved and target <> alias").limit(1).count()
        drop(now)
        now = new.drop("moved")
        now._quillon_path = new._quillon_path
        if not moved:
            return now
    raise RuntimeError("an alias chain has a cycle")


def alias_pairs(accounts: DataFrame, suffix: str, private: str = "noreply.github.com") -> DataFrame:
    """(alias, target). accounts: login, commits, emails. Accounts with a common public address go to the one of
    most commits; others whose login without the work suffix is another login go to that one; chains are collapsed."""
    mails = accounts.select("login", "commits", F.explode("emails").alias("email")).where((F.col("email") != "") & ~F.col("email").endswith(private))
    best = mails.groupBy("email").agg(F.max_by("login", F.struct("commits", "login")).alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_mail = mails.join(best, "email").where("login <> target").groupBy(F.col("login").alias("alias")).agg(F.max("target").alias("target"))
    rest = accounts.join(by_mail, accounts["login"] == by_mail["alias"], "left_anti").join(by_mail.select(F.col("target").alias("c")).distinct(), F.col("login") == F.col("c"), "left_anti")
    bare = rest.select(F.col("login").alias("alias"), F.lower(F.regexp_replace("login", suffix, "")).alias("bare")).where(F.col("bare") != F.lower("alias"))
    other = accounts.select(F.lower("login").alias("bare"), F.col("login").alias("target"))
    by_suffix = bare.join(other, "bare").where("alias <> target").select("alias", "target")
    return collapse_chains(by_mail.unionByName(by_suffix))


def exact_groups(rows: DataFrame, lab: str, day: str, title: str, key: str) -> DataFrame:
    """G1: (key, root) of rows with equal laboratory, day and normalised title, where there are several."""
    keyed = rows.withColumn("_title", normalised_title(F.col(title)))
    groups = keyed.groupBy(lab, day, "_title").agg(F.min(key).alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, [lab, day, "_title"]).select(F.col(key).alias("node"), "root")


def gated_pairs(rows: DataFrame, key: str, lab: str, day: str, kind: str, vector: str, days: int, high: float, low: float) -> DataFrame:
    """Pairs of one laboratory, close in time and of one event type, with their cosine and gate."""
    unit = rows.withColumn("_unit", normalised(F.col(vector)))
    pairs = band_pairs(unit, key, [lab, kind], day, days, carry=["_unit"])
    scored = pairs.withColumn("cosine", dot(F.col("_unit_a"), F.col("_unit_b"))).drop("_unit_a", "_unit_b")
    return scored.withColumn("gate", F.when(F.col("cosine") >= high, "merge").when(F.col("cosine") >= low, "defer").otherwise("apart"))


def groups_with_evidence(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Every row with its group, size and the strongest method among the group's edges (a, b, method)."""
    found = components(edges)
    rank = F.array_position(F.array(*map(F.lit, METHOD_RANK)), F.col("method"))
    best = edges.join(found, F.col("a") == F.col("node")).groupBy("root").agg(F.min_by("method", rank).alias("method"))
    all_rows = rows.select(F.col(key).alias("node")).join(found, "node", "left").select("node", F.coalesce("root", "node").alias("group_id"))
    sizes = all_rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    out = all_rows.join(sizes, "group_id").join(best.withColumnRenamed("root", "group_id"), "group_id", "left")
    return out.select(F.col("node").alias(key), "group_id", "size", F.coalesce("method", F.lit("single")).alias("method"))


def significance(score: str, ai_score: str):
    """G7."""
    return F.greatest(F.coalesce(score, F.lit(0.0)), F.coalesce(ai_score, F.lit(0.0)))


def resolve_identities(items: DataFrame, identities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items (kind, value, lab, name) -> person: the known identity, else the alias's canonical name, else the name."""
    known = items.join(identities.select("kind", "value", "lab", "person"), ["kind", "value", "lab"], "left")
    out = known.join(aliases.select(F.col("alias").alias("name"), "canonical"), "name", "left")
    return out.withColumn("person", F.coalesce("person", "canonical", "name"))


def absorb(children: DataFrame, merges: DataFrame, owner: str, clash: list[str], first: str, last: str) -> DataFrame:
    """Children move to their owner's canonical one; clashing ones become one, with the widest dates."""
    moved = children.join(merges.select(F.col("alias").alias(owner), "target"), owner, "left").withColumn(owner, F.coalesce("target", owner))
    return moved.groupBy(owner, *clash).agg(F.min(first).alias(first), F.max(last).alias(last))


def co_occurrence(items: DataFrame, group: str, member: str, least: int = 1) -> DataFrame:
    """(a, b, common) for members that share at least so many groups. The pairs of a group grow with its square,
    so groups are expected to be short lists, such as the authors of an article."""
    one = items.select(F.col(group).alias("g"), F.col(member).alias("a")).distinct()
    two = one.select("g", F.col("a").alias("b"))
    return one.join(two, "g").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least)


def alias_proposals(names: DataFrame, co: DataFrame, appears: DataFrame) -> DataFrame:
    """Pairs of one family name with compatible given names: co-authors in common, their Jaccard share and a verdict.

    names: name, given, family; co: name, others (a set); appears: name, articles (a set)."""
    from quillon.functions.text import given_names_compatible, strip_accents

    plain = F.trim(F.regexp_replace(F.lower(strip_accents("name")), r"[^\p{L}\p{N}]+", " "))
    full = names.withColumn("plain", plain).join(co, "name", "left").join(appears, "name", "left")
    side = lambda s: full.select(*[F.col(c).alias(f"{c}_{s}") for c in ("name", "given", "plain", "others", "articles")], F.col("family"))
    pairs = side("a").join(side("b"), "family").where("name_a < name_b").where(given_names_compatible(F.col("given_a"), F.col("given_b")))
    sets = lambda c: (F.coalesce(f"{c}_a", F.array()), F.coalesce(f"{c}_b", F.array()))
    common = F.size(F.array_intersect(*sets("others")))
    jaccard = F.coalesce(F.try_divide(common, F.size(F.array_union(*sets("others")))), F.lit(0.0))
    together = F.size(F.array_intersect(*sets("articles"))) > 0
    rank = F.when((F.col("plain_a") == F.col("plain_b")) & ~together, 0).when(together, 4).when((common >= 3) | (jaccard >= 0.3), 1).when(common > 0, 2).otherwise(3)
    verdict = F.get(F.array(*[F.lit(v) for v in ("same_string", "likely_same", "review", "weak", "reject")]), rank)
    return pairs.select("family", "name_a", "name_b", common.alias("common"), F.round(jaccard, 3).alias("jaccard"), verdict.alias("verdict")).orderBy(rank, F.desc("common"), "name_a", "name_b")


def resolve_titles(wanted: DataFrame, exact: DataFrame, relaxed: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The candidate of each wanted title and how it was found; titles without a trustworthy one go.

    wanted: id, title, description; exact, relaxed: what a search by title and one by any field found: id, seq, cand, cand_title,
    summary. First an exact hit of equal title, of several the first; else the only exact hit, if it has enough of the
    title's words; else the relaxed hit whose summary has most of the description's words, if enough."""
    from quillon.functions.text import content_words, overlap

    share = lambda a, b: F.coalesce(overlap(content_words(F.col(a)), content_words(F.col(b))), F.lit(0.0))
    first = wanted.join(exact, "id").withColumn("same", normalised_title(F.col("title")) == normalised_title(F.col("cand_title")))
    hits = first.groupBy("id").agg(
        F.min(F.when(F.col("same"), F.struct("seq", "cand"))).alias("equal"), F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "cand")).alias("only"),
        F.max(share("title", "cand_title")).alias("near"),
    )
    pick = F.when(F.col("equal").isNotNull(), F.col("equal.cand")).when((F.col("n") == 1) & (F.col("near") >= threshold), F.col("only.cand"))
    by_title = hits.select("id", pick.alias("cand"), F.lit("exact_title").alias("resolution")).where("cand is not null")
    second = wanted.join(by_title, "id", "left_anti").join(relaxed, "id").withColumn("near", share("description", "summary"))
    best = second.groupBy("id").agg(F.max(F.struct("near", (-F.col("seq")).alias("back"), "cand")).alias("best")).where(F.col("best.near") >= threshold)
    return by_title.unionByName(best.select("id", F.col("best.cand").alias("cand"), F.lit("relaxed_title").alias("resolution")))


def threshold_curve(scored: DataFrame, score: str, truth: str, grid: list[float]) -> DataFrame:
    """Tp, fp, fn, precision and recall at each threshold, from one pass: rows are counted by the number of
    thresholds that they reach, and the counts are summed over the short grid."""
    steps = sorted(grid)
    reached = sum((F.col(score) >= t).cast("int") for t in steps)
    counts = scored.groupBy(reached.alias("reached")).agg(F.count_if(F.col(truth)).alias("yes"), F.count_if(~F.col(truth)).alias("no"))
    marks = scored.sparkSession.createDataFrame(list(enumerate(steps, 1)), "nth int, threshold double")
    summed = marks.crossJoin(F.broadcast(counts)).groupBy("threshold").agg(
        F.sum(F.when(F.col("reached") >= F.col("nth"), F.col("yes")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("reached") >= F.col("nth"), F.col("no")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reached") < F.col("nth"), F.col("yes")).otherwise(0)).alias("fn"),
    )
    return summed.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def recommend_band(curve: DataFrame) -> DataFrame:
    """The least threshold without false positives, and the greatest without false negatives."""
    return curve.agg(F.min(F.when(F.col("fp") == 0, F.col("threshold"))).alias("high"), F.max(F.when(F.col("fn") == 0, F.col("threshold"))).alias("low"))
