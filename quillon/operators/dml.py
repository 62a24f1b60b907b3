"""Write semantics as pure functions of the old table and the new rows; the caller overwrites or appends the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, mark: str) -> tuple[DataFrame, DataFrame]:
    """M1, K1, K2: the merged table, and its counts added, updated, unchanged, kept, total.

    Of repeated keys in new the last by order counts. mark: the content hash, a column of both."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*old.columns), order).alias("_new"))
    both = old.select(F.struct(*old.columns).alias("_old"), F.col(key)).join(last, key, "full_outer")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "kept").when(F.col(f"_old.{mark}") == F.col(f"_new.{mark}"), "unchanged").otherwise("updated")
    both = both.withColumn("_state", state).withColumn("_row", F.coalesce("_new", "_old"))
    n = lambda s: F.count_if(F.col("_state") == s).alias(s)
    return both.select("_row.*"), both.agg(n("added"), n("updated"), n("unchanged"), n("kept"), F.count(F.lit(1)).alias("total"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """M2, M8: the rows to append: first of each new key that the table lacks. Keys match null with null."""
    fresh = new.dropDuplicates(keys)
    on = [fresh[k].eqNullSafe(old[k]) for k in keys]
    return fresh.join(old.select(*keys), on, "left_anti")


def rebuild_version(old: DataFrame, new: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """M3: one version's rows of the keys in new are replaced."""
    return old.where(F.col(version) != value).unionByName(old.where(F.col(version) == value).join(new.select(key).distinct(), key, "left_anti")).unionByName(new)


def replace_periods(old: DataFrame, new: DataFrame, keys: list[str], stats: str, preserve: list[str]) -> DataFrame:
    """M6: editions by period; a new one replaces the old but keeps some of its statistics (a map)."""
    from quillon.functions.maths import merged_maps

    was = old.select(*keys, F.col(stats).alias("_was"))
    fresh = new.join(was, keys, "left").withColumn(stats, F.when(F.col("_was").isNull(), F.col(stats)).otherwise(merged_maps(F.col("_was"), F.col(stats), preserve))).drop("_was")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh)


def close_stale(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Running rows that are older than the limit, and all but the newest, are closed as failed."""
    newest = runs.where("status = 'running'").agg(F.max("id").alias("_newest"))
    late = F.unix_timestamp(now) - F.unix_timestamp("started_at") > hours * 3600
    dead = (F.col("status") == "running") & (late | (F.col("id") != F.col("_newest")))
    return runs.crossJoin(F.broadcast(newest)).withColumn("status", F.when(dead, "failed").otherwise(F.col("status"))).drop("_newest")


def acknowledge(alerts: DataFrame, ids: list[int], at: Column) -> DataFrame:
    """M10."""
    return alerts.withColumn("acknowledged_at", F.when(F.col("id").isin(*ids) & F.col("acknowledged_at").isNull(), at).otherwise(F.col("acknowledged_at")))


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at path, after a swap that a crash cut short has been undone: the old table comes back."""
    fs, to = _files(spark, path)
    if not fs.exists(to(path)) and fs.exists(to(f"{path}.old")):
        fs.rename(to(f"{path}.old"), to(path))
    return fs.exists(to(path))


def _files(spark: SparkSession, path: str):
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def overwrite_atomically(df: DataFrame, path: str) -> None:
    """M4, M5, M7: written beside, then swapped in by two renames.

    A failure before them leaves the old table. One between them leaves it under .old, and recover() brings it back,
    which every writer and reader that may follow a crash calls first; .old is deleted only once a table stands at path."""
    fs, to = _files(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if recover(df.sparkSession, path):
        fs.delete(to(f"{path}.old"), True)
        if not fs.rename(to(path), to(f"{path}.old")):
            raise OSError(f"{path} couldn't be moved aside")
    if not fs.rename(to(f"{path}.new"), to(path)):
        raise OSError(f"{path}.new couldn't be moved in")
    fs.delete(to(f"{path}.old"), True)


def overwrite_version(df: DataFrame, path: str, version: str) -> None:
    """M3 on disk: only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def schema_drift(declared, actual: DataFrame) -> list[str]:
    """Columns that a schema declares and a table lacks or has in another type."""
    have = {f.name: f.dataType for f in actual.schema.fields}
    return [f.name for f in declared.fields if have.get(f.name) != f.dataType]
