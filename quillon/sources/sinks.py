"""Sinks: merged corpora and artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.dml import overwrite_atomically, upsert


def merge_corpus(old: DataFrame, new: DataFrame, path: str, key: str = "url", order: str = "date") -> dict[str, int]:
    """K1, K2: the corpus with new records, newest first inside each file, swapped in whole; returns the counts."""
    mark = F.sha2(F.to_json(F.struct(*sorted(old.columns)), {"ignoreNullFields": "false"}), 256)
    merged, counts = upsert(old.withColumn("_hash", mark), new.select(*old.columns).withColumn("_hash", mark), key, order, "_hash")
    out = counts.first().asDict()
    overwrite_atomically(merged.drop("_hash").sortWithinPartitions(F.desc(order), key), path)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """K4."""
    df.write.mode("overwrite").json(path)


def report_tables(counts: DataFrame, path: str) -> None:
    """K3: the figures under a report as one small table."""
    counts.coalesce(1).write.mode("overwrite").json(path)
