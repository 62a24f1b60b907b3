"""Structured Streaming forms of the cross-run operators: periods, sessions, episodes and failure streaks.

Sources are file streams; state is kept by key, bounded by watermarks where the operator allows it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums per period on the epoch grid; rows later than the watermark are dropped by the engine."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, late: str) -> DataFrame:
    """I2."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "n")


def sessions(events: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """I6 without the span cap: the engine's session windows."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, "w.start", "w.end", "n")


def first_of_episode(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each episode key within the watermark."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys)


def capped_sessions(events: DataFrame, key: str, gap_s: int, span_s: int, late: str) -> DataFrame:
    """I6 with a cap on the span, for events that arrive in order of time within a key (at: epoch seconds).

    A session is put out when the event after it arrives, or when the watermark (the latest event less `late`) has
    passed its gap; its state goes then."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        closed = []
        if state.hasTimedOut:
            closed.append((k[0], first, last, n))
            state.remove()
        else:
            for at in sorted(t for batch in batches for t in batch["at"].tolist()):
                if first is not None and (at - last > gap_s or at - first > span_s):
                    closed.append((k[0], first, last, n))
                    first, n = None, 0
                first = at if first is None else first
                last, n = at, n + 1
            state.update((first, last, n))
            state.setTimeoutTimestamp(max((last + gap_s) * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["key", "first_at", "last_at", "n"])

    out = "key long, first_at long, last_at long, n long"
    rows = events.withColumn("_at", F.timestamp_seconds("at")).withWatermark("_at", late)
    return rows.groupBy(key).applyInPandasWithState(step, out, "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def failure_streaks(events: DataFrame, key: str) -> DataFrame:
    """I8: after each batch the failures since the last success, for keys that had events (at, ok)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (streak,) = state.get if state.exists else (0,)
        rows = sorted((at, bool(ok)) for batch in batches for at, ok in zip(batch["at"], batch["ok"]))
        for _, ok in rows:
            streak = 0 if ok else streak + 1
        state.update((streak,))
        yield pd.DataFrame([(k[0], streak)], columns=["key", "consecutive_failures"])

    return events.groupBy(key).applyInPandasWithState(step, "key long, consecutive_failures long", "streak long", "update", GroupStateTimeout.NoTimeout)


def upserting(target: str, key: str, order: str, schema):
    """M1, M11 as a foreachBatch function: the batch lands before the checkpoint advances, and a batch that runs twice
    changes nothing."""
    from quillon.operators.dml import overwrite_atomically, recover

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.schema(schema).parquet(target).unionByName(batch) if recover(spark, target) else batch
        overwrite_atomically(rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*"), target)

    return write
