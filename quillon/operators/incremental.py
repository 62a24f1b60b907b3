"""Cross-run state: periods, cursors, watermarks, failure streaks, caches and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.dates import expires_at


def by_period(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Rows with the end day of their period on the epoch grid: (end - days, end]."""
    number = F.datediff(F.col(at), F.lit("1970-01-01"))
    return rows.withColumn("period_end", F.date_add(F.lit("1970-01-01").cast("date"), (F.ceil(number / days) * days).cast("int")))


def missing_periods(published: DataFrame, end: Column, days: int, most: int = 7) -> DataFrame:
    """The complete periods after the newest edition that have none: period_end on the epoch grid, and
    publish_at, the moment that publishes it, one period later; the latest few, oldest first.

    The period that the moment end itself publishes, the one before its own, is left to it. Without any edition there
    is nothing to catch up on."""
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / days).cast("int")
    day = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n * days)
    span = published.agg(F.max("period_end").alias("newest")).where("newest is not null").select((number(F.col("newest")) + 1).alias("first"), (number(end) - 2).alias("last"))
    grid = span.where("first <= last").select(F.explode(F.sequence("first", "last")).alias("n")).select(day(F.col("n")).alias("period_end"), day(F.col("n") + 1).alias("publish_at"))
    return grid.join(published.select("period_end"), "period_end", "left_anti").orderBy(F.desc("period_end")).limit(most).orderBy("period_end")


def advanced_watermarks(state: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """I4: the newest time of a key whose rows all succeeded (ok); otherwise, and without rows, the old mark."""
    new = batch.groupBy(key).agg(F.bool_and("ok").alias("ok"), F.max(at).alias("new"))
    out = state.join(new, key, "full_outer")
    return out.select(key, F.when(F.col("ok"), F.greatest("watermark", "new")).otherwise(F.col("watermark")).alias("watermark"))


def since_cursor(rows: DataFrame, cursors: DataFrame, key: str, at: str) -> DataFrame:
    """Rows after their key's cursor; all rows of a key without one."""
    return rows.join(cursors.select(key, "cursor"), key, "left").where(F.col("cursor").isNull() | (F.col(at) > F.col("cursor")))


def valid_cursors(cursors: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """A cursor into an empty store is forgotten."""
    return cursors.join(stored.select(key).distinct(), key, "left_semi")


def failure_streaks(events: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """I8: failures since the last success, and when that was. Two aggregates and no window: the events after the last
    success are counted."""
    last = events.groupBy(key).agg(F.max(F.when(F.col(ok), F.col(at))).alias("last_success"))
    after = events.where(~F.col(ok)).join(last, key).where(F.col("last_success").isNull() | (F.col(at) > F.col("last_success")))
    fails = after.groupBy(key).agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return last.join(fails, key, "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def failing(states: DataFrame, key: str, n: int) -> DataFrame:
    """Enabled sources with at least n failures, the worst first."""
    return states.where((F.col("consecutive_failures") >= n) & ~F.coalesce("disabled", F.lit(False))).orderBy(F.desc("consecutive_failures"), key)


def live_cache(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; those without a lifetime never do."""
    until = expires_at(F.col("fetched_at"), F.col("ttl_hours"), F.col("url"))
    return cache.where(until.isNull() | (until > now))


def episodes(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The first row of each episode key, and how many followed."""
    return rows.groupBy(*key).agg(F.min(F.struct(at, *[c for c in rows.columns if c not in (at, *key)])).alias("_f"), (F.count(F.lit(1)) - 1).alias("repeats")).select(*key, "_f.*", "repeats")


def dispatch(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with new, reopened (acknowledged before) or known. stored: dedupe_key, acknowledged_at."""
    one = candidates.dropDuplicates(["dedupe_key"])
    out = one.join(stored.select("dedupe_key", "acknowledged_at", F.lit(True).alias("_known")), "dedupe_key", "left")
    return out.withColumn("action", F.when(F.col("_known").isNull(), "new").when(F.col("acknowledged_at").isNotNull(), "reopen").otherwise("known")).drop("_known", "acknowledged_at")


def stalled(states: DataFrame, days: int) -> DataFrame:
    """Sources that succeed while their mark doesn't move."""
    return states.where(F.datediff("last_success_at", "watermark") >= days)


def due(legs: DataFrame, firing: Column) -> DataFrame:
    """Legs whose turn it is; a disabled one never."""
    return legs.where(~F.col("disabled") & ((firing - 1) % F.col("every") == 0))


def to_rewalk(listing: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Repositories that are new or were pushed to since."""
    return listing.join(stored.select(key, F.col("pushed_at").alias("_p")), key, "left").where(F.col("_p").isNull() | (F.col("_p") != F.col("pushed_at"))).drop("_p")


def quarantine(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Unresolved items with when they were first and last seen."""
    cols = [*keys, "first_seen", "last_seen"]
    return old.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def run_isolated(steps: dict, on_error=None) -> dict:
    """I16: every step in order; one that fails doesn't stop the others. Returns results or exceptions by name."""
    out = {}
    for name, step in steps.items():
        try:
            out[name] = step()
        except Exception as error:  # noqa: BLE001  a source's failure is recorded, not raised
            out[name] = error
            if on_error:
                on_error(name, error)
    return out


def islands(rows: DataFrame, key: str, order: list[str], same: Column) -> DataFrame:
    """Runs of equal values: a number that grows where the value changes."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_c", F.when(same == F.lag(same).over(w), 0).otherwise(1)).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
