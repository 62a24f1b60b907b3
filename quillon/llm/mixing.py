"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share 150 % of all words. A source's target
stops at twice its size; what is over is shared again by weight until none is above. Within a source longer documents
are worth more copies: a document of class k (2**k <= words < 2**(k+1)) gets min(2, c * (k + 1)) copies in expectation,
with c such that the source's words in expectation are its target. The whole part is taken for certain. The fractional
part is the inclusion probability p: documents are ranked by Pareto's odds (u / (1 - u)) / (p / (1 - p)) with u from a
digest of the id and the seed, and the shortest rank prefix goes in whose words come nearest to what the target lacks.

A source may hold any part of the rows, so no window runs over its documents. Words are first summed by source and
cell of the odds (partial aggregates), then by finer cells of the one in which the prefix ends, LEVELS times; only
documents of the last cell are ranked one by one, equal rows as one.

Defined results: a null text has no words and takes none; a null source is a source of its own, the last; a document of
null id has its u from its text; rows of one id and size go in together, ties in odds follow id, then size; sources
without words have the target 0; an empty table gives an empty result. Other columns pass through; mix() replaces size,
source_size, target, copies and taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import cut

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = "mix-2"
#: Cells of the odds at a level, and levels.
CELLS, LEVELS = 1 << 10, 3
#: More sources than this are no longer joined by broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """The runs of characters outside \\x20 and \\x09-\\x0D."""
    plain = F.translate(text, "\t\n\u000b\f\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")).cast("long"), F.lit(0).cast("long"))


def uniform(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of a digest of the id, or of the text where the id is null."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13)
    return (F.conv(digest, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def water_fill(rows: DataFrame, cap: Column, weight: Column, budget: Column, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with share: budget dealt by weight, no share above its cap. The level at which all weights fill is found in
    closed form: in the order of caps by weight, the first rows are full as long as the level that the others reach
    stands above. The windows run over aggregated rows."""
    rows = rows.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_budget", budget)
    all_rows = Window.partitionBy(*by)
    before = all_rows.orderBy(F.col("_cap") / F.col("_w"), tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_left", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_left"))
    is_open = F.col("_cap") >= F.col("_level") * F.col("_w")
    rows = rows.withColumn("_last", F.min(F.when(is_open, F.struct(F.col("_cap") / F.col("_w"), tie, "_level"))).over(all_rows)["_level"])
    share = F.when(F.col("_last").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_last") * F.col("_w")))
    return rows.withColumn("share", share).drop("_w", "_cap", "_budget", "_full", "_left", "_level", "_last")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, source_size) -> with target."""
    code = F.when(F.col("src").isNull(), 1).otherwise(0)
    rows = sources.withColumn("nth", F.row_number().over(Window.orderBy(code, F.encode("src", "utf-8"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    budget = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    return water_fill(rows, F.lit(float(most)) * F.col("source_size"), weight, budget, "nth").select("src", "source_size", F.col("share").alias("target"))


def length_class(size: Column) -> Column:
    """k where 2**k <= size < 2**(k+1); null for 0."""
    return F.when(size > 0, F.length(F.bin(size)) - 1)


def rates(classes: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """goal with rates, the expected copies by length class, and lack, the words that whole copies leave open."""
    same = F.col("src").eqNullSafe(F.col("s"))
    rows = classes.where("words > 0").join(goal.select(F.col("src").alias("s"), "target"), same).drop("s")
    words = F.col("words").cast("double")
    rows = water_fill(rows, most * words, (F.col("class") + 1) * words, F.col("target"), "class", ("src",)).withColumn("rate", F.col("share") / F.col("words"))
    entry = F.struct("class", "rate")
    by_source = rows.groupBy(F.col("src").alias("s")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("rates"), F.sum(F.floor("rate") * F.col("words")).alias("whole_words"))
    out = goal.join(by_source, same, "left").drop("s")
    return out.withColumn("lack", F.col("target") - F.coalesce("whole_words", F.lit(0))).drop("whole_words")


def _cell(odds: Column, level: int) -> Column:
    return F.floor(odds * F.lit(float(CELLS**level))).cast("long")


def ranked(rows: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """rows with _plan, the plan of their source, _rate and _odds: Pareto's odds carried into (0, 1) by x / (1 + x)."""
    packed = plan.select(F.col("src").alias("_key"), F.struct(*plan.columns).alias("_plan"))
    out = rows.join(F.broadcast(packed) if small else packed, F.col("_src").eqNullSafe(F.col("_key"))).drop("_key")
    out = out.withColumn("_rate", F.coalesce(F.try_element_at("_plan.rates", length_class(F.col("size"))), F.lit(0.0)))
    p = F.col("_rate") - F.floor("_rate")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    return out.withColumn("_odds", F.when(p > 0, odds / (1 + odds)))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, carry: bool = False) -> DataFrame:
    """A row per document: its id, size, source_size, target, copies and taken = copies * size.

    carry: keep all columns of docs, for a mix that is to be written; else only the id, and texts are read once."""
    names = docs.columns if carry else [id_col]
    own = ["size", "source_size", "target", "copies", "taken"]
    body = F.col(text).cast("string")
    rows = docs.select(*[F.col(c) for c in names if c not in own], F.col(source).cast("string").alias("_src"), n_words(body).alias("size"), uniform(F.col(id_col), body, seed).alias("_u"), F.col(id_col).alias("_id"))
    light = cut(rows.select("_id", "_src", "size", "_u"), "sizes")
    classes = cut(light.groupBy(F.col("_src").alias("src"), length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "classes")
    goal = cut(targets(classes.groupBy("src").agg(F.sum("words").alias("source_size"))), "targets")
    small = goal.count() <= BROADCAST_SOURCES
    plan = cut(rates(classes, goal).withColumn("end", F.lit(None).cast("long")).withColumn("before", F.lit(0).cast("long")), "plan")
    for level in range(1, LEVELS + 1):
        # The cell in which the words of the ranked documents first exceed what is lacking; none if all go in.
        tail = ranked(light, plan, small).where("_odds is not null")
        tail = tail.where(_cell(F.col("_odds"), level - 1) == F.col("_plan.end")) if level > 1 else tail
        cells = tail.groupBy(F.col("_src").alias("src"), _cell(F.col("_odds"), level).alias("cell")).agg(F.sum("size").alias("words"), F.first("_plan.lack").alias("lack"), F.first("_plan.before").alias("base"))
        until = F.col("base") + F.sum("words").over(Window.partitionBy("src").orderBy("cell"))
        ends = cells.withColumn("until", until).where("until > lack").groupBy(F.col("src").alias("s"))
        ends = ends.agg(F.min(F.struct("cell", (F.col("until") - F.col("words")).alias("before"))).alias("e"))
        plan = plan.join(ends, F.col("src").eqNullSafe(F.col("s")), "left").withColumn("end", F.col("e.cell")).withColumn("before", F.coalesce("e.before", "before")).drop("s", "e")
        plan = cut(plan, "plan")
    # The documents of the last cell one by one; equal ones are one row.
    tail = ranked(light, plan, small).where(_cell(F.col("_odds"), LEVELS) == F.col("_plan.end"))
    units = tail.groupBy("_src", "_odds", "_id", "size").agg(F.sum("size").alias("words"), F.first("_plan.lack").alias("lack"), F.first("_plan.before").alias("before"))
    order = Window.partitionBy("_src").orderBy("_odds", F.col("_id").asc_nulls_last(), "size")
    units = units.withColumn("until", F.col("before") + F.sum("words").over(order)).withColumn("nth", F.row_number().over(order))
    best = units.groupBy(F.col("_src").alias("s")).agg(F.min_by(F.struct("_odds", "_id", "size", F.abs(F.col("lack") - F.col("until")).alias("miss")), F.struct(F.abs(F.col("lack") - F.col("until")), "nth")).alias("m"), F.max(F.col("lack") - F.col("before")).alias("short"))
    # The prefix that ends before this cell is a choice as well.
    best = best.select("s", F.when(F.col("m.miss") < F.col("short"), F.col("m")).alias("last"))
    plan = plan.join(best, F.col("src").eqNullSafe(F.col("s")), "left").drop("s")
    out = ranked(rows if carry else light, plan, small)
    at, end, last, i = _cell(F.col("_odds"), LEVELS), F.col("_plan.end"), F.col("_plan.last"), F.col("_id")
    upto = (i < last["_id"]) | (i.isNotNull() & last["_id"].isNull()) | (i.eqNullSafe(last["_id"]) & (F.col("size") <= last["size"]))
    in_tail = F.coalesce((F.col("_odds") < last["_odds"]) | ((F.col("_odds") == last["_odds"]) & upto), F.lit(False))
    extra = F.when(F.col("_odds").isNull(), 0).when(end.isNull() | (at < end), 1).when(at > end, 0).when(in_tail, 1).otherwise(0)
    out = out.withColumn("copies", (F.floor("_rate") + extra).cast("long")).withColumn("source_size", F.col("_plan.source_size")).withColumn("target", F.col("_plan.target"))
    keep = [F.col(c) if carry else i.alias(c) for c in names if c not in own]
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*keep, *own)
