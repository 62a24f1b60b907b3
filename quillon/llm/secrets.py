"""Secret scans in DataFrame expressions: known formats, and sliding-window entropy over candidate strings.

Known formats: assignments to password-like names, access key ids, long hexadecimal runs. Beyond them, candidates
are runs of [A-Za-z0-9+/_=-]; known formats' spans are cut out of them, and each piece of at least WINDOW characters
that is left is measured by itself. A piece belongs to a character class (hexadecimal, mixed letters and digits,
mixed-case letters, letters with symbols); a window of WINDOW characters slides over it, and the Shannon entropy
follows from counts that change by the character that enters and the one that leaves. The stretch from the first to
the last window at or above the class's threshold is a span, unless the allow-list knows the piece (UUIDs, slugs and
paths of single-case or Capitalised words, alphabet runs, placeholders, one repeated character).

Defined results: a null text counts as empty and has no spans; repeated rows are scanned alike; ties in start follow
the order of KINDS, then the end. Other columns pass through; only secret_spans is replaced, and by redact() the
text and n_chars, if there is such a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.spans import SPAN, matches, redacted

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
#: Counts of five bits in one number.
PACKED = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits a character; 20 distinct characters would have 4.32.
THRESHOLDS = {"hex": 2.9, "mixed": 3.6, "cased": 4.0, "symbols": 4.0}
#: Candidates that are known to be harmless.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^[_=+/-]*([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,8})([_=+/-]+([a-z]{1,16}|[A-Z]{1,16}|[A-Z][a-z]{1,15}|[0-9]{1,8}))*[_=+/-]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem",
    r"(?i)0123456789|1234567890|abcdefghij|qwertyuiop",
    r"^(.)\1+$",
)


def char_class(s: Column) -> Column:
    digit, letter = s.rlike("[0-9]"), s.rlike("[A-Za-z]")
    return (
        F.when(s.rlike("^[0-9A-Fa-f]+$") & digit & letter, "hex")
        .when(digit & letter, "mixed")
        .when(s.rlike("[a-z]") & s.rlike("[A-Z]") & ~s.rlike("^[A-Z]?[a-z]+$") & ~s.rlike("[_=+/-]"), "cased")
        .when(letter & s.rlike("[_=+/-]"), "symbols")
    )


def dense_stretch(s: Column, threshold: Column, window: int = WINDOW) -> Column:
    """(first, last): the offsets of the first and of the last window of s at the threshold; nulls if none.

    The state holds the counts of the codes from '+' to 'z', which a window keeps under 32, in five bits each, twelve to
    a number, and the sum of c * log2(c) over the counts c. A step adds to one number for the code that enters, takes
    from one for the code that leaves, and changes the two terms that they have in the sum; no array is written anew.
    The entropy is log2(window) - sum / window."""
    if window > 31:
        raise ValueError("a window has at most 31 characters")
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - 43)
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    numbers = [f"n{k}" for k in range(-(-80 // PACKED))]
    zero = F.struct(
        *[F.lit(0).cast("long").alias(n) for n in numbers], F.lit(0.0).alias("sum"), F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), codes.alias("codes"),
    )

    def count(acc: Column, code: Column) -> Column:
        number = F.lit(0).cast("long")
        for k, n in reversed(list(enumerate(numbers))):
            number = F.when(code < PACKED * (k + 1), acc[n]).otherwise(number)
        return F.call_function("shiftright", number, 5 * (code % PACKED)).bitwiseAND(F.lit(31)).cast("int")

    def one(code: Column, k: int) -> Column:
        mine = (code >= PACKED * k) & (code < PACKED * (k + 1))
        return F.when(mine, F.call_function("shiftleft", F.lit(1).cast("long"), 5 * (code % PACKED))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, code: Column) -> Column:
        out = F.when(acc["i"] >= window, F.element_at(acc["codes"], F.greatest(acc["i"] - window, F.lit(0)) + 1)).otherwise(F.lit(-1))
        left = F.when(out >= 0, count(acc, F.greatest(out, F.lit(0)))).otherwise(F.lit(0))
        here = count(acc, code) - F.when(code == out, 1).otherwise(0)
        total = acc["sum"] - term(left) + term(left - 1) - term(here) + term(here + 1)
        dense = (acc["i"] + 1 >= window) & (F.lit(math.log2(window)) - total / window >= threshold - F.lit(1e-9))
        at = acc["i"] - (window - 1)
        return F.struct(
            *[(acc[n] + one(code, k) - one(out, k)).alias(n) for k, n in enumerate(numbers)], total.alias("sum"), (acc["i"] + 1).alias("i"),
            F.when(dense, F.coalesce(acc["first"], at)).otherwise(acc["first"]).alias("first"), F.when(dense, at).otherwise(acc["last"]).alias("last"), acc["codes"].alias("codes"),
        )

    return F.aggregate(codes, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def pieces(found: Column, base: Column) -> Column:
    """What sorted base spans leave of the found ones, in pieces of at least WINDOW characters."""

    def of(c: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            match = F.substring(c["match"], (start - c["start"] + 1).cast("int"), (end - start).cast("int"))
            one = F.array(F.struct(start.alias("start"), c["kind"].alias("kind"), end.alias("end"), match.alias("match")))
            return F.when(end - start >= WINDOW, one).otherwise(F.array().cast(SPAN))

        def step(acc: Column, b: Column) -> Column:
            return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out"))

        over = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        zero = F.struct(c["start"].alias("at"), F.array().cast(SPAN).alias("out"))
        rest = F.aggregate(over, zero, step, lambda acc: F.concat(acc["out"], piece(acc["at"], c["end"])))
        return F.when(F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])), rest).otherwise(F.array(c))

    return F.flatten(F.transform(found, of))


def entropy_spans(text: Column, base: Column, kind: int = 3) -> Column:
    """Spans of dense stretches in what base spans leave of the candidates."""
    free = lambda s: char_class(s["match"]).isNotNull() & ~allowed(s["match"])
    found = F.filter(pieces(matches(text, CANDIDATE, kind), base), free)
    threshold = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv]), char_class(m))
    dense = F.transform(found, lambda s: F.struct(s.alias("s"), dense_stretch(s["match"], threshold(s["match"])).alias("d")))
    dense = F.filter(dense, lambda x: x["d"]["first"].isNotNull())
    out = F.transform(dense, lambda x: F.struct(
        (x["s"]["start"] + x["d"]["first"]).alias("start"), F.lit(kind).alias("kind"), (x["s"]["start"] + x["d"]["last"] + WINDOW).alias("end"), x["s"]["match"].alias("match")))
    return F.when(F.coalesce(text.rlike(CANDIDATE), F.lit(False)), out).otherwise(F.array().cast(SPAN))


def allowed(s: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | s.rlike(pattern)
    return out


def base_spans(text: Column) -> Column:
    parts = [matches(text, ASSIGN, 0, lambda m, g: F.length(g) >= 6, group=1), matches(text, ACCESS, 1), matches(text, HEX, 2)]
    return F.array_sort(F.concat(*parts))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_spans, sorted: structs of start, kind (a place in KINDS), end and match."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.drop("secret_spans", "_base").withColumn("_base", base_spans(t))
    rows = rows.withColumn("secret_spans", F.array_sort(F.concat("_base", entropy_spans(t, F.col("_base")))))
    return rows.drop("_base")


def redact(docs: DataFrame, text: str = "text", marker: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced in the text; n_chars follows where it was the text's length."""
    rows = scan(docs, text)
    clean = redacted(F.col(text), F.col("secret_spans"), marker)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(kind))
    return rows.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
