"""Quality rules: text statistics, fixed rules, and robust multivariate outliers, in DataFrame operations only.

Each text gives counts (words, characters of words, symbols, repeated lines, words in repeated 3-word windows) and a
transformed vector: the logarithm of the words, the logarithm of the mean word length, and variance-stabilised
(arcsine of the root) shares of symbols, repeated lines and repeated words. Of the texts that pass the fixed rules, a
minimum-covariance-determinant estimate is made per language and source: from medians and scaled deviations, C-steps
refit mean and covariance to the three quarters of the rows that lie nearest; a reweighted step ends it. Groups of
under MIN_GROUP such rows take the estimate of their language, or else of all rows. A text whose squared Mahalanobis
distance exceeds CUT is rejected.

Vectors are rounded to 1/512, so that sums of them and of their products are exact in any order and medians come from
bounded tables of distinct values: reruns agree, and a group of any size is only ever met in partial aggregates.
FLOOR is added to the covariance's diagonal, as most clean texts have no symbol or repeated line at all. In a
group without any, repeated lines alone reject from a fifth of the lines, repeated words from a fifth of the words and
symbols from a fiftieth of the characters; one line twice among sixteen stays.

Defined results: a null text has no words and fails the rule of 50; null language or source is a value of its own;
without enough rows for an estimate (MIN_ROWS over all) only the fixed rules judge; repeated rows are judged alike; an
empty table gives an empty result. Other columns pass through; only n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words, distance, base_failed and kept are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.scratch import cut

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP, MIN_ROWS, STEPS = 200, 30, 3
DIM = 5
#: Least standard deviations of the five numbers.
FLOOR = (0.1, 0.08, 0.03, 0.1, 0.1)
#: Chi-squared of five degrees of freedom: quantiles at 3/4, 0.975 and (CUT) 0.999, and the factors that make the truncated covariance consistent.
HALF, HALF_FACTOR, NEAR, NEAR_FACTOR = 0.75, 1.41, 12.83, 1.06
CUT = 20.515
GRID = 512.0
#: More groups than this are no longer joined by broadcast.
BROADCAST_GROUPS = 20_000


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\u000b\f\r", "     "), " "), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice in the text.

    Windows go by 64-bit hashes; a text without two equal ones is done after one distinct count."""

    def of(h: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        tri = F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), window)).otherwise(F.array().cast("array<long>"))
        return let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))

    def covered(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce(again(x, j), x["h"] == F.get(s, j + 1)["h"]).alias("a"))), lambda y: y["a"]), lambda y: y["i"]))

        total = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return let(let(pairs, starts), total)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\u000b\f\r", "    ")) != "")
    counts = let(split_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    out = docs.withColumn("_c", counts).withColumn("n_words", F.col("_c.n")).withColumn("n_repeat_words", F.col("_c.r"))
    out = out.withColumn("word_chars", F.length(F.translate(t, " \t\n\u000b\f\r", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    out = out.withColumn("_l", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))))
    out = out.withColumn("n_dup_lines", F.col("_l.n") - F.col("_l.d")).withColumn("_lines", F.col("_l.n")).drop("_c", "_l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vector() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / b)))
    raw = [F.log(n), F.log(chars / n), share("n_symbols", chars), share("n_dup_lines", F.greatest("_lines", F.lit(1))), share("n_repeat_words", n)]
    return [F.round(x * GRID) / GRID for x in raw]


def _distance(prefix: str) -> Column:
    """Squared Mahalanobis distance by forward substitution with the factors that _factors() gave the group."""
    ys: list[Column] = []
    total = F.lit(0.0)
    for i in range(DIM):
        y = F.get("x", F.lit(i)) - F.col(f"{prefix}.m{i}")
        for j in range(i):
            y = y - F.col(f"{prefix}.l{i}{j}") * ys[j]
        ys.append(y)
        total = total + y * y / F.col(f"{prefix}.d{i}")
    return total


def _moments(rows: DataFrame) -> DataFrame:
    """Sums of the vectors and of their products for each group."""
    x = [F.get("x", F.lit(i)) for i in range(DIM)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return rows.groupBy("level", "lang_", "source_").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _factors(moments: DataFrame, factor: float) -> DataFrame:
    """Means and the L D L' factors of the covariance, a column each; one row per group."""
    out = moments
    for i in range(DIM):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(DIM):
        for j in range(i + 1):
            c = F.greatest(F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0) if i == j else F.lit(-1e300))
            out = out.withColumn(f"c{i}{j}", factor * c + (FLOOR[i] ** 2 if i == j else 0.0))
    for j in range(DIM):
        d = F.col(f"c{j}{j}")
        for k in range(j):
            d = d - F.col(f"l{j}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
        out = out.withColumn(f"d{j}", F.greatest(d, F.lit(FLOOR[j] ** 2 / 4)))
        for i in range(j + 1, DIM):
            v = F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}")
            out = out.withColumn(f"l{i}{j}", v / F.col(f"d{j}"))
    fields = [f"m{i}" for i in range(DIM)] + [f"d{i}" for i in range(DIM)] + [f"l{i}{j}" for i in range(DIM) for j in range(i)]
    return out.select("level", "lang_", "source_", F.struct(*fields).alias("fit"))


_KEYS = ("level", "lang_", "source_")


def _with(rows: DataFrame, groups: DataFrame, broadcast: bool, how: str = "inner") -> DataFrame:
    """Null languages and sources were given values before, so keys are plain."""
    return rows.join(F.broadcast(groups) if broadcast else groups, list(_KEYS), how)


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The fit of every group of enough rows, and whether the groups are few enough for a broadcast.

    rows: level, lang_, source_, x for the rows that take part, once for each level."""
    start = [F.percentile(F.get("x", F.lit(i)), F.lit(0.5)).alias(f"m{i}") for i in range(DIM)]
    sizes = cut(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("rows"), *start).where(F.col("rows") >= F.when(F.col("level") == 2, MIN_ROWS).otherwise(MIN_GROUP)), "medians")
    small = sizes.count() <= BROADCAST_GROUPS
    centred = _with(rows, sizes, small)
    deviation = [F.percentile(F.abs(F.get("x", F.lit(i)) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i in range(DIM)]
    spread = centred.groupBy(*_KEYS, *[f"m{i}" for i in range(DIM)]).agg(*deviation)
    first = [F.col(f"m{i}") for i in range(DIM)]
    first += [(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOOR[i] ** 2).alias(f"d{i}") for i in range(DIM)]
    first += [F.lit(0.0).alias(f"l{i}{j}") for i in range(DIM) for j in range(i)]
    fit = cut(spread.select(*_KEYS, F.struct(*first).alias("fit")), "fit")
    for _ in range(STEPS):
        near = _with(rows, fit, small).select(*_KEYS, "x", F.round(F.log2(1 + _distance("fit")) * 64).alias("far"))
        bound = cut(near.groupBy(*_KEYS).agg(F.percentile("far", F.lit(HALF)).alias("bound")), "bound")
        fit = cut(_factors(_moments(_with(near, bound, small).where("far <= bound")), HALF_FACTOR), "fit")
    near = _with(rows, fit, small).where(_distance("fit") <= NEAR)
    return cut(_factors(_moments(near), NEAR_FACTOR), "fit"), small


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the text, with the statistics, base_failed, distance (null where no estimate is) and kept."""
    rest = [c for c in docs.columns if c not in (text, *STATS, "base_failed", "distance", "kept")]
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = statistics(docs.select(*rest, F.col(text)), text).drop(text)
    rows = cut(rows.withColumn("x", F.array(*vector())).withColumn("lang_", name(lang)).withColumn("source_", name(source)), "statistics")
    every = F.lit("any")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang_").alias("a"), F.col("source_").alias("b")),
        F.struct(F.lit(1).alias("level"), F.col("lang_").alias("a"), every.alias("b")),
        F.struct(F.lit(2).alias("level"), every.alias("a"), every.alias("b")),
    )
    part = rows.where(~F.col("base_failed")).select("x", F.explode(levels).alias("k")).select(F.col("k.level").alias("level"), F.col("k.a").alias("lang_"), F.col("k.b").alias("source_"), "x")
    fits, small = estimates(part)
    hint = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    own = fits.where("level = 0").select("lang_", "source_", F.col("fit").alias("fit0"))
    of_lang = fits.where("level = 1").select("lang_", F.col("fit").alias("fit1"))
    of_all = fits.where("level = 2").select(F.lit(1).alias("one"), F.col("fit").alias("fit2"))
    out = rows.join(hint(own), ["lang_", "source_"], "left").join(hint(of_lang), "lang_", "left").withColumn("one", F.lit(1)).join(F.broadcast(of_all), "one", "left")
    out = out.withColumn("fit", F.coalesce("fit0", "fit1", "fit2")).withColumn("distance", _distance("fit"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT))
    return out.select(*rest, *STATS, "base_failed", "distance", "kept")


