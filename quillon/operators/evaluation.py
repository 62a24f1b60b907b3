"""Agreement, error and sampling statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.maths import LEVELS, lookup, round_binary
from quillon.operators.windows import average_rank


def ratio(a: Column, b: Column) -> Column:
    """0 over nothing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(reference: Column, run: Column) -> Column:
    """Struct of precision, recall and f1 of two arrays as sets; two empty ones agree fully."""
    hit = F.size(F.array_intersect(reference, run)).cast("double")
    p, r = ratio(hit, F.size(F.array_distinct(run))), ratio(hit, F.size(F.array_distinct(reference)))
    f = ratio(2 * p * r, p + r)
    empty = (F.size(reference) == 0) & (F.size(run) == 0)
    return F.when(empty, F.struct(F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("f1"))).otherwise(F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1")))


def axis(pairs: DataFrame, reference: str, run: str) -> DataFrame:
    """Micro and macro measures over pairs of sets, and how many agree fully."""
    ref, got = F.array_distinct(reference), F.array_distinct(run)
    hit = F.size(F.array_intersect(ref, got))
    each = pairs.select(hit.alias("tp"), (F.size(got) - hit).alias("fp"), (F.size(ref) - hit).alias("fn"), prf(F.col(reference), F.col(run)).alias("m"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return each.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"),
        F.round(F.avg("m.f1"), 6).alias("macro_f1"), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("identical"),
    )


def kappa(rows: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """Cohen's kappa from the table of counts; 1 where chance alone agrees fully."""
    cells = rows.groupBy(*group, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    margins = cells.select(*group, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("label")), F.struct(F.lit("b").alias("side"), F.col("b").alias("label")))).alias("x"), "c")
    margins = margins.groupBy(*group, "x.label").agg(F.sum(F.when(F.col("x.side") == "a", F.col("c")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == "b", F.col("c")).otherwise(0)).alias("nb"))
    chance = margins.groupBy(*group).agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("chance"))
    same = cells.groupBy(*group).agg(F.sum("c").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    both = same.join(chance, list(group)) if group else same.crossJoin(chance)
    o, e = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return both.select(*group, F.col("n").cast("long").alias("n"), F.round(o, 6).alias("observed"), F.round(F.when(e == 1, 1.0).otherwise((o - e) / (1 - e)), 6).alias("kappa"))


def pearson(rows: DataFrame, a: str, b: str) -> DataFrame:
    """E4; 0 where a series is constant."""
    return rows.agg(F.round(F.coalesce(F.nanvl(F.corr(a, b), F.lit(None)), F.lit(0.0)), 6).alias("pearson"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's measure of average ranks."""
    ranked = average_rank(average_rank(rows.select(a, b), a, "_ra"), b, "_rb")
    return pearson(ranked, "_ra", "_rb").withColumnRenamed("pearson", "spearman")


def errors(rows: DataFrame, a: str, b: str, group: list[str] = ()) -> DataFrame:
    """E5: mean absolute and root mean square error, equal values, equal signs."""
    d = F.col(a) - F.col(b)
    return rows.groupBy(*group).agg(
        F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.count_if(d == 0).alias("identical"),
        F.count_if(F.signum(F.col(a).cast("double")) == F.signum(F.col(b).cast("double"))).alias("same_sign"),
    )


def compare_bylines(gold: DataFrame, run: DataFrame, fields: list[str]) -> DataFrame:
    """Per article the matched, missed and invented names, whether their order agrees, and differing fields."""
    g = gold.select("article", "name", F.col("position").alias("pg"), *[F.col(f).alias(f"{f}_g") for f in fields])
    r = run.select("article", "name", F.col("position").alias("pr"), *[F.col(f).alias(f"{f}_r") for f in fields])
    both = g.join(r, ["article", "name"], "full_outer")
    matched = F.col("pg").isNotNull() & F.col("pr").isNotNull()
    order = F.sort_array(F.collect_list(F.when(matched, F.struct("pg", "pr"))))
    counts = [F.count_if(matched & ~F.col(f"{f}_g").eqNullSafe(F.col(f"{f}_r"))).alias(f"{f}_differs") for f in fields]
    out = both.groupBy("article").agg(F.count_if(matched).alias("matched"), F.count_if(F.col("pr").isNull()).alias("missed"), F.count_if(F.col("pg").isNull()).alias("invented"), order.alias("o"), *counts)
    ranks = F.transform("o", lambda x: x["pr"])
    return out.withColumn("order_agrees", ranks == F.sort_array(ranks)).drop("o")


def majority(votes: DataFrame, item: str, run: str, choice: str) -> DataFrame:
    """Choices that more than half of an item's runs made."""
    runs = votes.groupBy(item).agg(F.countDistinct(run).alias("runs"))
    return votes.groupBy(item, choice).agg(F.countDistinct(run).alias("votes")).join(runs, item).where(F.col("votes") >= F.floor(F.col("runs") / 2) + 1)


def lower_median(rows: DataFrame, group: list[str], value: str, name: str = "median") -> DataFrame:
    """The lower of the middle values."""
    return rows.groupBy(*group).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").cast("double").alias(name))


def median_level(rows: DataFrame, group: list[str], level: str) -> DataFrame:
    """The lower median of ordinal labels."""
    out = lower_median(rows.withColumn("_r", lookup(LEVELS, F.col(level))), group, "_r", "_m")
    name = F
    for k, v in LEVELS.items():
        name = name.when(F.col("_m") == v, k)
    return out.withColumn(level, name).drop("_m")


def variance(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Spread of repeated measurements."""
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(value).alias("distinct"), F.round(F.max(value) - F.min(value), 4).alias("range"), F.round(F.stddev_samp(value), 4).alias("stdev"))


def confusion(rows: DataFrame, truth: str, run: str, group: list[str]) -> DataFrame:
    """Counts by slice, the agreement, and the items that were missed."""
    t, r = F.col(truth), F.col(run)
    out = rows.groupBy(*group).agg(F.count_if(t & r).alias("tp"), F.count_if(~t & r).alias("fp"), F.count_if(t & ~r).alias("fn"), F.count_if(~t & ~r).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumn("agreement", F.round(ratio(F.col("tp") + F.col("tn"), n), 6)).withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def label_diff(a: DataFrame, b: DataFrame, key: str, tag: str, value: str) -> DataFrame:
    """Tags that one side lacks or holds with another value."""
    both = a.select(key, tag, F.col(value).alias("a")).join(b.select(key, tag, F.col(value).alias("b")), [key, tag], "full_outer")
    kind = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") != F.col("b"), "differs")
    return both.withColumn("kind", kind).where("kind is not null")


def label_impact(base: DataFrame, diffs: DataFrame, key: str, tag: str, value: str, score: Callable[[Column], Column], digits: int = 1) -> DataFrame:
    """label_diff(other, base)'s rows with the change of the score if base took this one side's label.

    score turns an item's values, an array that may be empty, into a number; items are rescored once a difference."""
    tags = base.groupBy(key).agg(F.collect_list(F.struct(F.col(tag).alias("t"), F.col(value).alias("v"))).alias("_tags"))
    rows = diffs.join(tags, key, "left").withColumn("_tags", F.coalesce("_tags", F.array().cast(tags.schema["_tags"].dataType)))
    rest = F.transform(F.filter("_tags", lambda x: x["t"] != F.col(tag)), lambda x: x["v"])
    after = F.when(F.col("a").isNull(), rest).otherwise(F.concat(rest, F.array("a")))
    change = score(after) - score(F.transform("_tags", lambda x: x["v"]))
    return rows.withColumn("impact", round_binary(change, digits)).drop("_tags")


def apply_verdicts(tags: DataFrame, verdicts: DataFrame, key: str, tag: str, value: str) -> DataFrame:
    """Drop removes, adjust replaces the value, add brings a tag, confirm and no verdict keep it."""
    both = tags.select(key, tag, value).join(verdicts.select(key, tag, "verdict", F.col(value).alias("_new")), [key, tag], "full_outer")
    both = both.where(F.coalesce(F.col("verdict") != "drop", F.lit(True))).where(F.col(value).isNotNull() | (F.col("verdict") == "add"))
    return both.select(key, tag, F.when(F.col("verdict").isin("adjust", "add"), F.coalesce("_new", value)).otherwise(F.col(value)).alias(value))


def migrate_tags(tags: DataFrame, tag: str, sign: str, renamed: dict[str, tuple[str, bool]], retired: list[str]) -> DataFrame:
    """Renamed tags (some with the sign turned) and, instead of retired ones, a reason to classify anew."""
    turned = F.when(F.col(sign) == "positive", "negative").when(F.col(sign) == "negative", "positive").otherwise(F.col(sign))
    new, way = F, F
    for old, (to, turn) in renamed.items():
        new = new.when(F.col(tag) == old, to)
        way = way.when(F.col(tag) == old, turned if turn else F.col(sign))
    out = tags.withColumn("_new", new.otherwise(F.col(tag)) if renamed else F.col(tag)).withColumn(sign, way.otherwise(F.col(sign)) if renamed else F.col(sign))
    return out.withColumn("migrated", F.col("_new") != F.col(tag)).withColumn(tag, F.col("_new")).drop("_new").withColumn("reason", F.when(F.col(tag).isin(*retired), F.concat(F.lit("retired: "), F.col(tag))))


def version_deltas(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """Both scores and their change."""
    return old.select(key, F.col(score).alias("old")).join(new.select(key, F.col(score).alias("new")), key).withColumn("delta", F.round(F.col("new") - F.col("old"), 4))
