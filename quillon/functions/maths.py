"""Weights, scores, vectors, hashes and cost arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = {"high": 3.0, "medium": 2.0, "low": 1.0}
#: Confidence is a gate: low is worth nothing.
GATE = {"high": 1.0, "medium": 0.5, "low": 0.0}
MOST = 3.0


def lookup(values: dict[str, float], key: Column) -> Column:
    """A literal map as CASE, which stays inside generated code; null for an unknown key."""
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out


def sign_product(a: Column, b: Column) -> Column:
    """mixed absorbs; equal signs are positive."""
    return F.when((a == "mixed") | (b == "mixed"), "mixed").when(a == b, "positive").otherwise("negative")


def opposite(direction: Column) -> Column:
    """Null for mixed, which contradicts nothing."""
    return F.when(direction == "positive", "negative").when(direction == "negative", "positive")


def weight(magnitude: Column, confidence: Column) -> Column:
    """F61."""
    return lookup(LEVELS, magnitude) * lookup(GATE, confidence) / F.lit(MOST)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """scaled to length one; a zero vector stays."""
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))), 1)


def cosine(a: Column, b: Column) -> Column:
    """F62; a difference in width is an error."""
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in width")).cast("double"))
    return F.coalesce(checked, dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_floats(packed: pd.Series) -> pd.Series:
    """little-endian 32-bit floats from bytes (unbase64 comes before)."""
    return packed.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def pack_floats(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def content_hash(*columns: str) -> Column:
    """F64: SHA-256 of a row as JSON with its fields sorted."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def call_cost(tokens_in: Column, tokens_out: Column, cached: Column, rate_in: Column, rate_out: Column, batch: Column, cache_rate: float = 0.1) -> Column:
    """dollars from rates a million tokens; cached input is cheap, batches cost half."""
    full = (tokens_in * rate_in + cached * rate_in * cache_rate + tokens_out * rate_out) / 1e6
    return F.when(batch, full / 2).otherwise(full)


def projected_spend(spent: Column, calls: Column, in_flight: Column, fallback: float) -> Column:
    """What is spent and what the running calls will cost at the mean so far."""
    return spent + in_flight * F.when(calls > 0, spent / calls).otherwise(fallback)


def affordable(budget: Column, per_call: Column) -> Column:
    """F67."""
    return F.floor(F.try_divide(budget, per_call))


def sorted_map(m: Column) -> Column:
    """entries by value, the largest first, then by key."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def merged_maps(old: Column, new: Column, preserve: list[str]) -> Column:
    """the new map, but for preserved keys the old values."""
    kept = F.map_filter(old, lambda k, _: k.isin(*preserve))
    return F.map_concat(F.map_filter(new, lambda k, _: ~F.map_contains_key(kept, k)), kept)


def round_binary(values: Column, digits: int) -> Column:
    """to a number of digits, half to even on the exact binary value; SQL's ROUND goes by the decimal text."""

    @F.pandas_udf(T.DoubleType())
    def rounded(v: pd.Series) -> pd.Series:
        return v.map(lambda x: x if x is None or x != x else round(x, digits))

    return rounded(values.cast("double"))
