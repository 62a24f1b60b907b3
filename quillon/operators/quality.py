"""Data-quality rules: each gives the violations as check, severity, key and message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _out(rows: DataFrame, check: str, key: Column, message: str, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def unique(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    """V1, V9."""
    return _out(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), check, F.concat_ws("|", *keys), "stands more than once")


def refers(rows: DataFrame, key: str, to: DataFrame, to_key: str, check: str) -> DataFrame:
    """V2."""
    missing = rows.select(F.col(key).alias("k")).dropna().distinct().join(to.select(F.col(to_key).alias("k")), "k", "left_anti")
    return _out(missing, check, F.col("k"), "refers to nothing")


def required(rows: DataFrame, key: str, fields: list[str], check: str) -> DataFrame:
    """V3."""
    return reduce(lambda a, b: a.unionByName(b), [_out(rows.where(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")), check, F.col(key), f"lacks {f}") for f in fields])


def member(rows: DataFrame, key: str, field: str, allowed: list[str], check: str) -> DataFrame:
    """V4."""
    return _out(rows.where(~F.col(field).isin(*allowed)), check, F.col(key), f"{field} has an unknown value")


def in_range(rows: DataFrame, key: str, field: str, low: float, high: float, check: str) -> DataFrame:
    """V5."""
    return _out(rows.where(~F.col(field).between(low, high)), check, F.col(key), f"{field} is out of range")


def holds(rows: DataFrame, key: str, rule: Column, check: str, message: str) -> DataFrame:
    """V6, V7: an order or an exclusion between fields."""
    return _out(rows.where(~F.coalesce(rule, F.lit(False))), check, F.col(key), message)


def complete(expected: DataFrame, rows: DataFrame, key: str, check: str) -> DataFrame:
    """V8."""
    return _out(expected.select(key).distinct().join(rows.select(key), key, "left_anti"), check, F.col(key), "isn't covered")


def exactly_one(rows: DataFrame, key: str, fields: list[str], check: str) -> DataFrame:
    """V10."""
    n = sum(F.col(f).isNotNull().cast("int") for f in fields)
    return _out(rows.where(n != 1), check, F.col(key), "needs exactly one of " + ", ".join(fields))


def unknown_keys(rows: DataFrame, key: str, entries: str, allowed: list[str], check: str) -> DataFrame:
    """Keys of a map that nobody knows."""
    extra = F.array_except(F.map_keys(entries), F.array(*map(F.lit, allowed)))
    return _out(rows.where(F.size(extra) > 0), check, F.col(key), "has unknown keys")


def violations(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)
