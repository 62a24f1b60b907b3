"""Ranking, runs and series: one row per group, tied tops, sessions, streaks, lags and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.maths import weight


def anchors(rows: DataFrame, group: str, merit: str, day: str, key: str, latest: bool | Column = False) -> DataFrame:
    """A group's representative: most merit, then the earliest (of release trains the latest) day and key.

    An aggregate, not a window: one row per group is met on each side of the shuffle."""
    sign = F.when(latest if isinstance(latest, Column) else F.lit(latest), 1).otherwise(-1)
    order = F.struct(F.coalesce(merit, F.lit(0.0)).alias("m"), (sign * F.datediff(F.col(day), F.lit("1970-01-01"))).alias("d"), (sign * F.col(key)).alias("k"))
    return rows.groupBy(group).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"), F.count(F.lit(1)).alias("group_size")).select("_r.*", "group_size")


def first_passing(rows: DataFrame, group: str, passes: Column, merit: str, day: str, key: str) -> DataFrame:
    """The best member of each group that passes; group sizes count all members."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    return anchors(rows.where(passes), group, merit, day, key).drop("group_size").join(sizes, group)


def strongest_tag(tags: DataFrame, key: str) -> DataFrame:
    """The tag of most weight, the earliest of equals; none if all weigh nothing."""
    w = tags.withColumn("weight", weight(F.col("magnitude"), F.col("confidence"))).where("weight > 0")
    return w.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("n"), *[F.col(c) for c in ("ordinal", "mechanism", "weight")])).alias("t")).select(key, "t.ordinal", "t.mechanism", "t.weight")


def tied_top(rows: DataFrame, group: str, member: str, strength: str, prefer: Column | None = None) -> DataFrame:
    """All members whose best strength, to four places, is the group's; each once, the preferred and first ahead."""
    rank = F.round(strength, 4)
    one = rows.groupBy(group, member).agg(F.max(rank).alias("top"), F.max(F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(False)).alias("preferred"))
    best = one.groupBy(group).agg(F.max("top").alias("best"))
    tied = one.join(best, group).where("top = best")
    order = F.struct((~F.col("preferred")).alias("p"), F.col(member).alias("m"))
    return tied.groupBy(group).agg(F.max("top").alias("strength"), F.transform(F.sort_array(F.collect_list(order)), lambda x: x["m"]).alias("members"))


def rank_key(a: str, b: str) -> tuple[Column, Column]:
    """The greater of two scores first, the lesser next."""
    return F.greatest(a, b), F.least(a, b)


def gap_sessions(rows: DataFrame, group: list[str], at: str, key: str, gap_seconds: int) -> DataFrame:
    """W7, I6 without a cap: session numbers from 1 per group; a longer gap begins a new one."""
    order = Window.partitionBy(*group).orderBy(at, key)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(order) <= F.lit(gap_seconds * 1_000_000), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def capped_sessions(rows: DataFrame, group: list[str], at: Column, key: str, gap: int, span: int) -> DataFrame:
    """Sessions that also end where the distance from their first row exceeds a span.

    The cap makes each boundary depend on the one before, so it is a fold. Gaps cut a group into independent stretches
    first, by a window that streams over its partition, so the fold holds one stretch and never a whole group."""
    order = Window.partitionBy(*group).orderBy("_at", key)
    base = rows.withColumn("_at", at).withColumn("_new", F.when(F.col("_at") - F.lag("_at").over(order) <= gap, 0).otherwise(1))
    base = base.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    zero = F.struct(F.lit(None).cast("long").alias("first"), F.lit(0).alias("n"), F.array().cast("array<struct<k:long,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = F.coalesce(x["t"] - acc["first"] > span, F.lit(True))
        n = acc["n"] + over.cast("int")
        return F.struct(F.when(over, x["t"]).otherwise(acc["first"]).alias("first"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), n.alias("n")))).alias("out"))

    packed = F.sort_array(F.collect_list(F.struct(F.col("_at").cast("long").alias("t"), F.col(key).cast("long").alias("k"))))
    folded = base.groupBy(*group, "_run").agg(packed.alias("all")).withColumn("marks", F.aggregate("all", zero, step, lambda a: a["out"]))
    return folded.select(*group, F.col("_run").alias("run"), F.explode("marks").alias("m")).select(*group, F.col("m.k").alias(key), F.struct("run", "m.n").alias("train"))


def trailing_streak(days: DataFrame, group: str, day: str) -> DataFrame:
    """Consecutive days up to the group's last one. days: distinct rows of group and day.

    A day minus its rank is the same along a run; only the last run's is needed."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(day))
    runs = days.withColumn("_run", F.date_sub(F.col(day), rank)).groupBy(group, "_run").agg(F.count(F.lit(1)).alias("streak"), F.max(day).alias("last_day"))
    return runs.groupBy(group).agg(F.max_by("streak", "last_day").alias("streak"), F.max("last_day").alias("last_day"))


def lag_change(series: DataFrame, group: str, period: str, value: str, periods: int = 4) -> DataFrame:
    """Percent change over so many rows back; null until there are that many."""
    order = Window.partitionBy(group).orderBy(period)
    before = F.lag(value, periods).over(order)
    return series.withColumn("change_pct", F.round(100.0 * (F.try_divide(F.col(value), before) - 1), 4))


def window_delta(series: DataFrame, group: str, period: str, value: str) -> DataFrame:
    """First and last value, their change in percent, the highest, and the series."""
    packed = F.sort_array(F.collect_list(F.struct(period, F.col(value).alias("v"))))
    out = series.groupBy(group).agg(F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"), F.max(value).alias("highest"), packed.alias("s"))
    return out.withColumn("change_pct", F.round(100.0 * (F.try_divide("last", "first") - 1), 4)).withColumn("series", F.transform("s", lambda x: x["v"])).drop("s")


def counterfactual(series: DataFrame, group: str, period: str, shares: str, price: str) -> DataFrame:
    """The cash that trading moved, against holding the first position to the end; a missing price is an error."""
    order = Window.partitionBy(group).orderBy(period)
    checked = F.coalesce(F.col(price), F.raise_error(F.concat(F.lit("no price: "), F.col(group).cast("string"))).cast("double"))
    rows = series.withColumn("_p", checked).withColumn("_d", F.col(shares) - F.lag(shares).over(order))
    return rows.groupBy(group).agg(
        F.round(-F.coalesce(F.sum(F.col("_d") * F.col("_p")), F.lit(0.0)), 2).alias("flow"),
        F.round(F.min_by(shares, period) * F.max_by("_p", period), 2).alias("untraded"), F.round(F.max_by(shares, period) * F.max_by("_p", period), 2).alias("held"),
    )


def top_per_period(rows: DataFrame, period: str, name: str, value: str, n: int) -> DataFrame:
    """The n largest names of each period; ties by name. Sums come first, so a window meets one row per name."""
    sums = rows.groupBy(period, name).agg(F.sum(value).alias("total"))
    order = Window.partitionBy(period).orderBy(F.desc("total"), name)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def churn(tops: DataFrame, period: str, name: str) -> DataFrame:
    """Names ever and always in the top, and the mean overlap of consecutive periods."""
    numbered = tops.select(name, F.dense_rank().over(Window.orderBy(period)).alias("p"))
    spans = numbered.groupBy(name).agg(F.countDistinct("p").alias("n"))
    count = numbered.agg(F.countDistinct("p").alias("periods"))
    nxt = numbered.select(F.col(name), (F.col("p") - 1).alias("p"))
    carried = numbered.join(nxt, [name, "p"], "left_semi").agg(F.count(F.lit(1)).alias("carried"))
    out = spans.crossJoin(F.broadcast(count)).groupBy("periods").agg(F.count(F.lit(1)).alias("ever"), F.count_if(F.col("n") == F.col("periods")).alias("always"))
    return out.crossJoin(carried).select("ever", "always", F.round(F.try_divide(F.col("carried"), F.col("periods") - 1), 4).alias("mean_carried"))


def cohort(tops: DataFrame, values: DataFrame, period: str, name: str, value: str) -> DataFrame:
    """The first period's top with its value then and in the last period."""
    ends = values.agg(F.min(period).alias("p0"), F.max(period).alias("p1"))
    then = tops.join(F.broadcast(ends.select(F.col("p0").alias(period))), period, "left_semi").select(name, F.col("total").alias("then"))
    now = values.join(F.broadcast(ends.select(F.col("p1").alias(period))), period, "left_semi").groupBy(name).agg(F.sum(value).alias("now"))
    return then.join(now, name, "left").select(name, "then", F.coalesce("now", F.lit(0.0)).alias("now"))


def verify_prices(series: DataFrame, group: str, period: str, ours: str, theirs: str, split: float = 0.4, tolerance: float = 0.02, last: int = 4) -> DataFrame:
    """Quarters after the last jump of 40 percent (if any are left), the last four of them, and their worst error."""
    rows = series.withColumn("error", F.abs(F.try_divide(F.col(ours), F.col(theirs)) - 1))
    jumps = rows.groupBy(group).agg(F.max(F.when(F.col("error") >= split, F.col(period))).alias("jump"), F.max(period).alias("newest"))
    rows = rows.join(jumps, group).where(F.col("jump").isNull() | (F.col("jump") == F.col("newest")) | (F.col(period) > F.col("jump")))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(period)))
    out = rows.withColumn("_n", n).where(F.col("_n") <= last).groupBy(group, "jump")
    return out.agg(F.count(F.lit(1)).alias("checked"), F.round(F.max("error"), 6).alias("worst"), F.max_by(period, F.struct("error", period)).alias("worst_at")).withColumn("ok", F.col("worst") <= tolerance)


def downsampled(rows: DataFrame, group: str, order: list[str], every: int) -> DataFrame:
    """Every so many rows, and always the last."""
    w = Window.partitionBy(group).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("_n", n).withColumn("_next", F.lead(F.lit(1)).over(w)).where(((F.col("_n") - 1) % every == 0) | F.col("_next").isNull()).drop("_n", "_next")


def first_mentions(mentions: DataFrame, word: str, day: str, url: str, corpus: str) -> DataFrame:
    """The earliest document of each identifier, with how often and where else it stands."""
    return mentions.groupBy(word).agg(F.min(F.struct(day, url)).alias("f"), F.count(F.lit(1)).alias("mentions"), F.sort_array(F.collect_set(corpus)).alias("corpora")).select(
        word, F.col(f"f.{day}").alias("first_seen"), F.col(f"f.{url}").alias("first_url"), "mentions", "corpora"
    )


def average_rank(rows: DataFrame, value: str, name: str, group: list[str] = ()) -> DataFrame:
    """Ranks in which ties share their mean. Counts per value come first: the window meets distinct values only."""
    per = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy(value)) - F.col("_c")
    ranks = per.withColumn(name, before + (F.col("_c") + 1) / F.lit(2.0)).drop("_c")
    return rows.join(ranks, [*group, value])


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole row of the greatest order per key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")).select("_r.*")


def within_budget(rows: DataFrame, cost: str, order: list[Column], limit: float, group: list[str] = ()) -> DataFrame:
    """Rows in order as long as the running cost stays within the limit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= limit)


def byline_positions(articles: DataFrame, key: str, authors: str) -> DataFrame:
    """A row for each author of a byline, an array in order: position from 1, and n_authors."""
    return articles.select(key, F.posexplode(authors).alias("position", "name"), F.size(authors).alias("n_authors")).withColumn("position", F.col("position") + 1)
