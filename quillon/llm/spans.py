"""Spans of regular expression matches in DataFrame expressions: code point offsets, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,kind:int,end:long,match:string>>"


def matches(text: Column, pattern: str, kind: int, ok=None, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, match), those that ok(match, group's text) holds for.

    Only texts that have a match pay for more than the search. Offsets are running lengths of the pieces between
    matches and of the matches, so each text is cut once."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    rows = F.zip_with(F.arrays_zip(pieces.alias("p"), whole.alias("m")), inner, lambda pm, g: F.struct(pm["p"].alias("p"), pm["m"].alias("m"), g.alias("g")))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["p"])
        end = begin + F.length(row["m"])
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["m"].alias("match")))
        good = F.lit(True) if ok is None else ok(row["m"], row["g"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(SPAN)
    found = F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(none)


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, marker: str) -> Column:
    """text with every stretch under sorted spans replaced by the marker; overlapping spans count as one."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(marker))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, between).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, rest)).otherwise(text)
