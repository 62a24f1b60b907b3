"""Personal data by boosted trees over generated candidates, in DataFrame operations only.

Generators of high recall propose spans, which may overlap: four known formats (email, ip, card, phone) and looser
ones (masked mail addresses, national phone numbers, social security numbers, IBANs, IPv6). A known format whose check
passes (octets, Luhn, number of digits) decides for itself; those spans always stay. The looser ones, where their own
check (ranges, remainder) doesn't rule them out, are up to a classifier: each candidate has a code of format features
(digits, separators, prefix, length) and context features (neighbouring characters, words before it that speak for or
against personal data). Neither a candidate's kind nor the outcome of its check is a feature. Gradient boosting of
depth-two trees learns from candidates whose label the check tells: known formats and IBANs that pass or fail it, and decoys such
as dates and versions, which are never personal. It needs only the number of candidates for each code, label and fold,
a table of at most 2 ** (features + 2) rows however large the corpus is, aggregated over all documents. A scale fitted
on the held-out fold calibrates the scores, and the threshold is the least one whose precision there is PRECISION.
A loose candidate at or above it becomes a span if no known-format span overlaps it; of loose ones that overlap each
other, the first stays.

Defined results: a null text counts as empty and has no spans; without labelled candidates of both classes no loose
span is added; repeated rows are scanned alike; ties in start follow the order of KINDS, then the end; an empty table
gives an empty result. Other columns pass through; only pii_spans is replaced, and by redact() the text and n_chars.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.scratch import cut
from quillon.llm.spans import SPAN, matches, redacted

KINDS = ("email", "ip", "card", "phone", "mail_masked", "phone_national", "ssn", "iban", "ip6")
DECOY, IBAN_KIND = len(KINDS), 7
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}"
NATIONAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
DECOYS = r"(?<![0-9A-Za-z.:/+-])[0-9]{1,4}(?:[./:-][0-9]{1,4}){1,2}(?![0-9A-Za-z:/-])"
#: What all candidates hold.
ANY = r"[0-9@]|[\[(]\x20?(?:at|AT)\x20?[\])]"
FOR = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|ssn|social|card|iban|account|address|name|reach)\W{0,6}\w{0,6}\W{0,3}$"
AGAINST = r"(?i)(?:version|ver|v|order|isbn|invoice|total|page|section|figure|fig|table|no|nr|chapter|eur|usd|[$\u20ac])\W{0,4}$"
FEATURES = ("digits7", "digits10", "digits13", "separated", "plus", "at", "letters", "left_word", "right_word", "after_colon", "speaks_for", "speaks_against", "long")
TREES, RATE, PRECISION, CONTEXT = 40, 0.3, 0.98, 24


def luhn(digits: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def check(kind: Column, m: Column) -> Column:
    """Whether a candidate passes what its kind can check by itself."""
    digits = F.translate(m, "+ ().-", "")
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, m.rlike(rf"^0*{octet}(?:\.0*{octet}){{3}}$"))
        .when(kind == 2, F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False))
        .when(kind == 3, F.length(digits).between(10, 15))
        .when(kind == 5, m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"))
        .when(kind == 6, ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"))
        .when(kind == 7, mod97(m))
        .otherwise(kind < DECOY)
    )


def mod97(iban: Column) -> Column:
    plain = F.translate(iban, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97) == 1


def known_formats(text: Column) -> Column:
    ok = lambda k: lambda m, _: check(F.lit(k), m)
    return F.concat(matches(text, EMAIL, 0), matches(text, IP, 1, ok(1)), matches(text, CARD, 2, ok(2)), matches(text, PHONE, 3, ok(3)))


def candidates(text: Column) -> Column:
    """All proposed spans of a text, sorted."""
    patterns = (EMAIL, IP, CARD, PHONE, MASKED, NATIONAL, SSN, IBAN, IP6, DECOYS)
    long_enough = lambda m, _: F.length(m) >= 4
    found = F.concat(*[matches(text, p, k, long_enough if k in (2, DECOY) else None) for k, p in enumerate(patterns)])
    return F.when(F.coalesce(text.rlike(ANY), F.lit(False)), F.array_sort(found)).otherwise(F.array().cast(SPAN))


def described(text: Column, spans: Column) -> Column:
    """start, kind, end, code and pass of each candidate; bit i of the code is FEATURES[i]."""

    def one(s: Column) -> Column:
        m, kind = s["match"], s["kind"]
        n = F.length(F.regexp_replace(m, "[^0-9]", ""))
        left = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        right = F.substring(text, (s["end"] + 1).cast("int"), F.lit(1))
        passes = check(kind, m)
        bits = [n >= 7, n >= 10, n >= 13, m.rlike(r"[0-9)][\x20().-]+[0-9(]"), m.startswith("+"), m.rlike(r"(?i)@|[\[(]\x20?at"), m.rlike("[A-Za-z]"),
                left.rlike(r"[\p{L}\p{N}_]$"), right.rlike(r"^[\p{L}\p{N}_]"), left.rlike(r"[:=]\x20?$"), left.rlike(FOR), left.rlike(AGAINST), F.length(m) >= 12]
        code = F.lit(0)
        for i, b in enumerate(bits):
            code = code + F.when(b, 1 << i).otherwise(0)
        return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), code.alias("code"), passes.alias("passes"))

    return F.transform(spans, one)


class Boosted:
    """Depth-two trees over bits of a code, and the scale and threshold of their sum."""

    def __init__(self, trees: list[tuple[int, int, int, list[float]]], start: float, scale: tuple[float, float], threshold: float):
        self.trees, self.start, self.scale, self.threshold = trees, start, scale, threshold

    def raw(self, code: int) -> float:
        return self.start + sum(v[2 * (code >> a & 1) + (code >> (c if code >> a & 1 else b) & 1)] for a, b, c, v in self.trees)

    def chance(self, code: int) -> float:
        z = self.scale[0] * self.raw(code) + self.scale[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def selects(self, code: Column) -> Column:
        """The trees as expressions: only trees that are left after equal ones are merged."""
        merged: dict[tuple[int, int, int], list[float]] = {}
        for a, b, c, v in self.trees:
            old = merged.setdefault((a, b, c), [0.0] * 4)
            merged[a, b, c] = [x + y for x, y in zip(old, v)]
        bit = lambda i: code.bitwiseAND(F.lit(1 << i)) > 0
        z = F.lit(self.start)
        for (a, b, c), v in merged.items():
            z = z + F.when(bit(a), F.when(bit(c), v[3]).otherwise(v[2])).otherwise(F.when(bit(b), v[1]).otherwise(v[0]))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), self.scale[0] * z + self.scale[1]))))
        return p >= self.threshold


def _split(has: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, float]:
    """Gain, feature and both leaves' values (Newton's) of the best split of some rows."""
    g1, h1 = g @ has, h @ has
    g0, h0 = g.sum() - g1, h.sum() - h1
    gain = g0 * g0 / (h0 + 1) + g1 * g1 / (h1 + 1)
    i = int(np.argmax(gain))
    return float(gain[i]), i, float(g0[i] / (h0[i] + 1)), float(g1[i] / (h1[i] + 1))


def boost(rows: list[tuple[int, int, int, float]]) -> Boosted | None:
    """rows: (code, label, fold, count); fold 0 calibrates. None if a class is missing."""
    train = [(c, y, n) for c, y, f, n in rows if f] or [(c, y, n) for c, y, f, n in rows]
    held = [(c, y, n) for c, y, f, n in rows if not f] or train
    if len({y for _, y, _ in train}) < 2:
        return None
    total = sum(n for *_, n in train)
    share = sum(n for _, y, n in train if y) / total
    start = math.log(share / (1 - share))
    code, y, n = (np.array(c) for c in zip(*train))
    has = (code[:, None] >> np.arange(len(FEATURES)) & 1).astype(bool)
    z = np.full(len(code), start)
    trees: list[tuple[int, int, int, list[float]]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = n * (y - p), n * p * (1 - p)
        best = None
        for a in range(len(FEATURES)):
            sides = [_split(has[on], g[on], h[on]) for on in (~has[:, a], has[:, a])]
            gain = sides[0][0] + sides[1][0]
            if best is None or gain > best[0] + 1e-9:
                best = (gain, a, *sides)
        _, a, off, on = best
        tree = (a, off[1], on[1], [RATE * off[2], RATE * off[3], RATE * on[2], RATE * on[3]])
        trees.append(tree)
        second = np.where(has[:, a], has[:, tree[2]], has[:, tree[1]])
        z = z + np.array(tree[3])[2 * has[:, a] + second]
    model = Boosted(trees, start, (1.0, 0.0), 1.1)
    raw, y, n = (np.array(c, dtype=float) for c in zip(*((model.raw(c), y, n) for c, y, n in held)))
    model.scale = _scale(raw, y, n)
    z = np.clip(model.scale[0] * raw + model.scale[1], -30, 30)
    chance = 1 / (1 + np.exp(-z))
    order = np.argsort(-chance, kind="stable")
    good, seen, c = np.cumsum((y * n)[order]), np.cumsum(n[order]), chance[order]
    ends = np.flatnonzero(np.append(c[1:] != c[:-1], True))  # rows of one chance are selected together
    precise = ends[good[ends] / seen[ends] >= PRECISION]
    if len(precise):
        model.threshold = max(float(c[precise[-1]]), 0.5)
    return model


def _scale(raw: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Platt's scale by gradient steps, drawn towards (1, 0)."""
    a, b, x, share = 1.0, 0.0, np.clip(raw, -10, 10), n / (n.sum() or 1.0)
    for _ in range(200):
        e = share * (y - 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))))
        a, b = max(0.2, a + 0.1 * (float(e @ x) - 0.01 * (a - 1))), b + 0.1 * (float(e.sum()) - 0.01 * b)
    return a, b


def fit(found: DataFrame, column: str = "_found") -> Boosted | None:
    """From the described candidates of all documents. Labels: known formats and IBANs, whose remainder is as telling, by their check; decoys never.

    A number that fails one kind's check but is a part of another kind's candidate (the digits of a phone number are no
    card) tells nothing and is left out."""
    good = F.filter(column, lambda o: o["passes"] & (o["kind"] < DECOY))
    apart = lambda s: ~F.exists(good, lambda o: (o["kind"] != s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"]))
    told = F.filter(column, lambda s: F.when((s["kind"] <= 3) | (s["kind"] == IBAN_KIND), s["passes"] | apart(s)).otherwise((s["kind"] == DECOY) & apart(s)))
    rows = found.select(F.explode(told).alias("c"))
    label = F.when(F.col("c.kind") == DECOY, 0).otherwise(F.col("c.passes").cast("int"))
    fold = F.when(F.pmod(F.xxhash64(F.col("c.start"), F.col("c.end"), F.col("c.code")), F.lit(4)) == 0, 0).otherwise(1)
    counts = rows.groupBy(F.col("c.code").alias("code"), label.alias("label"), fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return boost(sorted((r.code, r.label, r.fold, float(r.n)) for r in counts.collect()))


def chosen(found: Column, model: Boosted | None) -> Column:
    """The spans that stay: known formats that pass, and loose candidates that the model selects; sorted."""
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.filter(found, lambda s: (s["kind"] <= 3) & s["passes"])
    if model is None:
        return F.transform(base, plain)
    loose = F.filter(found, lambda s: (s["kind"] > 3) & (s["kind"] < DECOY) & s["passes"] & model.selects(s["code"]))
    free = F.filter(loose, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,kind:int,end:long>>").alias("out"))
    add = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(plain(s))).alias("out")))
    first = F.aggregate(free, zero, add, lambda acc: acc["out"])
    return F.array_sort(F.concat(F.transform(base, plain), first))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column _found of described candidates."""
    rows = docs.withColumn("_candidates", candidates(_text(text)))
    return rows.withColumn("_found", described(_text(text), F.col("_candidates"))).drop("_candidates")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with pii_spans: sorted structs of start, kind (a place in KINDS) and end. One pass over texts."""
    found = cut(describe(docs.drop("pii_spans"), text).drop(text), "candidates")
    return found.withColumn("pii_spans", chosen(F.col("_found"), fit(found))).drop("_found")


def redact(docs: DataFrame, text: str = "text", marker: str = "[PII]") -> DataFrame:
    """docs with all personal data replaced in the text; texts are read twice, to fit and to replace."""
    model = fit(describe(docs.select(text), text).select("_found"))
    rows = describe(docs, text).withColumn("_spans", chosen(F.col("_found"), model))
    clean = redacted(F.col(text), F.col("_spans"), marker)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length(clean)).otherwise(F.col("n_chars")).cast(kind))
    return rows.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)
