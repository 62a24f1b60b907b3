"""Routes from items to holdings, and the joins that compare, link, diff and align tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.maths import opposite, sign_product, weight
from quillon.functions.text import MIN_ALIAS, MIN_TICKER, bounded_pattern, match_name, stem

CONNECTION = ("article", "isin", "route", "via", "direction", "strength")


def mechanism_route(tags: DataFrame, edges: DataFrame, ceiling: float) -> DataFrame:
    """Tags (article, mechanism, sign, magnitude, confidence) with edges (isin and the same); worthless ones go."""
    e = edges.select("isin", "mechanism", *[F.col(c).alias(f"e_{c}") for c in ("sign", "magnitude", "confidence")])
    strength = weight(F.col("magnitude"), F.col("confidence")) * weight(F.col("e_magnitude"), F.col("e_confidence")) * ceiling
    out = tags.join(e, "mechanism").withColumn("strength", F.round(strength, 4)).where("strength > 0")
    return out.select("article", "isin", F.lit("mechanism").alias("route"), F.col("mechanism").alias("via"), sign_product(F.col("sign"), F.col("e_sign")).alias("direction"), "strength")


def category_route(tags: DataFrame, membership: DataFrame, routable: DataFrame, ceiling: float) -> DataFrame:
    """Only categories that may route; the direction is the item's own sign."""
    good = tags.join(routable.select("category"), "category", "left_semi")
    out = good.join(membership.select("isin", "category"), "category").withColumn("strength", F.round(weight(F.lit("high"), F.col("confidence")) * ceiling, 4)).where("strength > 0")
    return out.select("article", "isin", F.lit("category").alias("route"), F.col("category").alias("via"), F.col("sign").alias("direction"), "strength")


def exposure_route(articles: DataFrame, edges: DataFrame, ceiling: float) -> DataFrame:
    """Articles (article, lab, score) of a score over 0 with live edges (isin, lab, kind, magnitude, confidence, is_dormant)."""
    live = edges.where(~F.col("is_dormant")).select("isin", "lab", "kind", "magnitude", "confidence")
    out = articles.where("score > 0").join(live, "lab").withColumn("strength", F.round(weight(F.col("magnitude"), F.col("confidence")) * ceiling, 4)).where("strength > 0")
    return out.select("article", "isin", F.lit("exposure").alias("route"), F.concat_ws(":", "lab", "kind").alias("via"), F.lit("mixed").alias("direction"), "strength")


def named_route(articles: DataFrame, holdings: DataFrame, strength: float = 0.3) -> DataFrame:
    """Holdings (isin, name, aliases, ticker) that a text names: name, then aliases, then ticker; one hit each.

    A text meets only the names whose first word it holds: an equality join on the distinct words of texts and the
    first words of names. The whole pattern then decides."""
    names = F.filter(F.array(F.struct(F.lit(0).alias("rank"), F.lit("name").alias("kind"), match_name(F.col("name")).alias("word"))), lambda x: x["word"].isNotNull())
    aliases = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.length(a) >= MIN_ALIAS), lambda a, i: F.struct((i + 1).alias("rank"), F.lit("alias").alias("kind"), a.alias("word")))
    ticker = F.trim(F.coalesce("ticker", F.lit("")))
    tickers = F.when(F.length(ticker) >= MIN_TICKER, F.array(F.struct(F.lit(1_000_000).alias("rank"), F.lit("ticker").alias("kind"), ticker.alias("word"))))
    words = holdings.select("isin", F.explode(F.concat(names, aliases, F.coalesce(tickers, F.array().cast("array<struct<rank:int,kind:string,word:string>>")))).alias("c")).select("isin", "c.*")
    words = words.withColumn("pattern", F.when(F.col("kind") == "ticker", bounded_pattern(F.col("word"), False)).otherwise(bounded_pattern(F.col("word"), True)))
    tokens = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")
    # A name without a word is looked for in every text.
    words = words.withColumn("first", F.coalesce(F.get(tokens("word"), F.lit(0)), F.lit("")))
    held = articles.select("article", F.explode(F.array_append(F.array_distinct(tokens("text")), F.lit(""))).alias("first"))
    # The text isn't carried along with each of its words; it joins the few that are left.
    hits = articles.select("article", "text").join(held.join(words, "first"), "article").where(F.expr("rlike(text, pattern)"))
    best = hits.groupBy("article", "isin").agg(F.min_by(F.concat_ws(":", "kind", "word"), F.struct("rank", "word")).alias("via"))
    return best.select("article", "isin", F.lit("named").alias("route"), "via", F.lit("mixed").alias("direction"), F.lit(strength).alias("strength"))


def union_best(routes: list[DataFrame], keys: list[str], strength: str = "strength") -> DataFrame:
    """The routes one under the other; of equal keys the strongest, of equally strong ones the earlier route's."""
    numbered = [r.withColumn("_route", F.lit(i)) for i, r in enumerate(routes)]
    rows = reduce(lambda a, b: a.unionByName(b), numbered)
    rest = [c for c in rows.columns if c not in (*keys, "_route")]
    order = F.struct((-F.col(strength)).alias("s"), F.col("_route"), *[F.col(c) for c in rest])
    return rows.groupBy(*keys).agg(F.min(order).alias("_best")).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def drop_contradicted(connections: DataFrame) -> DataFrame:
    """A category row goes where a mechanism row of the same article and holding points the other way."""
    against = connections.where("route = 'mechanism'").select("article", "isin", opposite(F.col("direction")).alias("direction")).dropna()
    others = connections.where("route <> 'category'")
    return others.unionByName(connections.where("route = 'category'").join(against, ["article", "isin", "direction"], "left_anti"))


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a counterpart, in a fixed order."""
    return all_rows.join(done.select(key), key, "left_anti").orderBy(key)


def settled(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """J10."""
    return all_rows.join(done.select(key), key, "left_semi")


def stale(rows: DataFrame, cache: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """Rows that the cache lacks or holds under other marks."""
    return rows.join(cache.select(key, *marks), [key, *marks], "left_anti")


def band_pairs(rows: DataFrame, key: str, same: list[str], day: str, days: int, carry: list[str] = ()) -> DataFrame:
    """Pairs a < b of one group with |days between| <= days.

    The day is cut into buckets as wide as the band, and a row looks at its own and the next bucket, so the join is an
    equality on group and bucket, and a long group doesn't meet itself whole. Each pair comes out once: ordered by day."""
    number = F.datediff(F.col(day), F.lit("1970-01-01")).cast("long")
    width = max(1, days)
    base = rows.select(F.col(key).alias("k"), *same, number.alias("d"), *carry).withColumn("bucket", F.floor(F.col("d") / width))
    left = base.select(*[F.col(c).alias(f"{c}_l") for c in ("k", "d", *carry)], *same, F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    both = left.join(base, [*same, "bucket"]).where((F.col("d") - F.col("d_l")).between(0, days) & ((F.col("d") > F.col("d_l")) | (F.col("k") > F.col("k_l"))))
    first = F.col("k_l") < F.col("k")
    pick = lambda c, a: F.when(first == F.lit(a), F.col(f"{c}_l")).otherwise(F.col(c))
    return both.select(*same, F.least("k_l", "k").alias("a"), F.greatest("k_l", "k").alias("b"), (F.col("d") - F.col("d_l")).alias("gap"), *[x for c in carry for x in (pick(c, True).alias(f"{c}_a"), pick(c, False).alias(f"{c}_b"))])


def overlap_links(left: DataFrame, right: DataFrame, same: str, words: str, day: str, days: int) -> DataFrame:
    """(a, b, evidence) where both share a word within a time band; the evidence is the longest word, then the first.

    left, right: id, the group, an array of words and a day. Days are cut into buckets as wide as the band, and the left
    side looks at its own and the next on both sides, so a common word doesn't meet itself over all time."""
    number = F.datediff(F.col(day), F.lit("1970-01-01"))
    bucket = F.floor(number / max(1, days))
    word = F.explode(F.array_distinct(words)).alias("word")
    a = left.select(F.col("id").alias("a"), same, number.alias("day_a"), bucket.alias("at"), word).withColumn("at", F.explode(F.array(*[F.col("at") + n for n in (-1, 0, 1)])))
    b = right.select(F.col("id").alias("b"), same, number.alias("day_b"), bucket.alias("at"), word)
    pairs = a.join(b, [same, "word", "at"]).where(F.abs(F.col("day_a") - F.col("day_b")) <= days)
    return pairs.groupBy("a", "b").agg(F.min(F.struct((-F.length("word")).alias("n"), F.col("word"))).getField("word").alias("evidence"))


def release_links(rows: DataFrame, events: list[str], days: int, most: int = 3) -> DataFrame:
    """(a, b, evidence) of a release and an announcement of one laboratory that name the same model.

    rows: id, lab, event_type, repo (null or empty unless a release), models, day. models: the identifiers of a release's body
    or of an announcement's title; they also meet by their stems. A release that names more than `most` is about none; an
    announcement counts only if its event type is one of `events`."""
    release = F.coalesce(F.col("repo") != "", F.lit(False))
    words = rows.withColumn("words", F.array_union("models", F.transform("models", stem)))
    from_ = words.where(release & (F.size(F.array_distinct("models")) <= most))
    return overlap_links(from_, words.where(~release & F.col("event_type").isin(*events)), "lab", "words", "day", days)


def known_link(rows: DataFrame, key: str, links: str, known: DataFrame) -> DataFrame:
    """The first link of a row that the known ones (url) hold, closing slashes aside; null if none."""
    each = rows.select(key, F.posexplode(links).alias("pos", "link"))
    hits = each.join(known.select(F.col("url").alias("bare")).distinct(), F.regexp_replace("link", "/+$", "") == F.col("bare"))
    first = hits.groupBy(key).agg(F.min_by("link", "pos").alias("duplicate_of"))
    return rows.join(first, key, "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def with_label(rows: DataFrame, labels: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """A dimension's label, or the key itself."""
    return rows.join(labels.select(F.col(key), F.col(label).alias("_label")), key, "left").withColumn(name, F.coalesce("_label", F.col(key).cast("string"))).drop("_label")


def on_derived_key(left: DataFrame, right: DataFrame, derived: Column, key: str, states: tuple[str, str, str]) -> DataFrame:
    """A left join on a computed key, with a state: no key, no partner, found."""
    out = left.withColumn("_key", derived).join(right.withColumn("_found", F.lit(True)), F.col("_key") == F.col(key), "left")
    return out.withColumn("state", F.when(F.col("_key").isNull(), states[0]).when(F.col("_found").isNull(), states[1]).otherwise(states[2])).drop("_key", "_found")


def lookup_all(rows: DataFrame, key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """The value (value) of every source for a key, a column each, null where it has none."""
    return reduce(lambda d, s: d.join(s[1].select(key, F.col("value").alias(s[0])), key, "left"), sources.items(), rows)


def full_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with both values and entered, left, changed or same."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    state = F.when(F.col("old").isNull(), "entered").when(F.col("new").isNull(), "left").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return both.withColumn("state", state)


def turnover(diff: DataFrame) -> DataFrame:
    """Totals of a full_diff and the changed names in percent of the old ones, at least one."""
    n = lambda s: F.count_if(F.col("state") == s)
    base = F.greatest(F.lit(1), F.count_if(F.col("old").isNotNull()))
    return diff.agg(n("entered").alias("entered"), n("left").alias("left"), n("changed").alias("changed"), F.round(100.0 * (n("entered") + n("left")) / base, 4).alias("turnover_pct"))


def as_of(left: DataFrame, right: DataFrame, same: list[str], at: str, when: str, values: list[str], tie: str) -> DataFrame:
    """The last right row at or before each left row, per group, as one sort of both sides instead of a theta join.

    Of right rows at one time the greatest tie counts. Left rows without one get nulls."""
    packed = F.struct(F.col(when).alias(when), *[F.col(v).alias(v) for v in values])
    one = right.groupBy(*same, when).agg(F.max(F.struct(F.col(tie).alias("_t"), packed.alias("_v"))).getField("_v").alias("_v"))
    lefts = left.withColumn("_v", F.lit(None).cast(one.schema["_v"].dataType)).withColumn("_side", F.lit(1)).withColumn("_at", F.col(at))
    rights = one.select(*same, "_v", F.lit(0).alias("_side"), F.col(when).alias("_at"))
    rows = lefts.unionByName(rights, allowMissingColumns=True)
    before = Window.partitionBy(*same).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(before)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in (*values,)], F.col(f"_last.{when}").alias("matched_at"))


def dense(periods: DataFrame, keys: DataFrame, facts: DataFrame, on: list[str], measures: list[str]) -> DataFrame:
    """Every key in every period, with zeros. Both sides of the product are dimensions."""
    full = periods.crossJoin(F.broadcast(keys)).join(facts, on, "left")
    return full.select(*on, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str, order: list[str]) -> DataFrame:
    """Parents with an ordered array of their children's structs; empty arrays for those without."""
    packed = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    kids = children.groupBy(key).agg(packed.alias(name))
    out = parents.join(kids, key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kids.schema[name].dataType)))


def both_ways(links: DataFrame, rendered: DataFrame) -> DataFrame:
    """Links (a, b, relation) from either end, both ends rendered (id), each once."""
    swapped = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation")
    ids = rendered.select("id")
    out = links.select("a", "b", "relation").unionByName(swapped)
    return out.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").dropDuplicates(["a", "b", "relation"])


def anchor_links(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) between groups' anchors; those inside a group go. groups: id, anchor."""
    g = lambda c: groups.select(F.col("id").alias(c), F.col("anchor").alias(f"{c}_anchor"))
    out = links.join(g("a"), "a", "left").join(g("b"), "b", "left").select(F.coalesce("a_anchor", "a").alias("a"), F.coalesce("b_anchor", "b").alias("b"))
    return out.where("a <> b").distinct()


#: Words that not_contained broadcasts; more of them meet the texts by their first letters.
MOST_WORDS = 10_000


def not_contained(words: DataFrame, texts: DataFrame, word: str, text: str, most: int = MOST_WORDS) -> DataFrame:
    """Words that no text contains; an empty word is in every text, a null one in none.

    The words are counted: at most `most` are broadcast and every text is met once. More meet on an equality of their first
    three letters and the texts' stretches of three (or fewer, for shorter words), and contains() decides."""
    small = words.select(F.col(word).alias("_w"), F.lower(F.col(word)).alias("_l")).distinct()
    low = texts.select(F.lower(F.col(text)).alias("_t"))
    if small.limit(most + 1).count() <= most:
        seen = low.join(F.broadcast(small), F.expr("contains(_t, _l)")).select("_w")
    else:
        starts = small.select("_w", "_l", F.substring("_l", 1, 3).alias("_start"))
        lengths = F.sequence(F.lit(0), F.length("_t"))
        pieces = F.array_distinct(F.flatten(F.transform(lengths, lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(F.col("_t"), i + 1, n)))))
        seen = low.withColumn("_start", F.explode(pieces)).join(starts, "_start").where("contains(_t, _l)").select("_w")
    return words.join(seen.distinct(), F.col(word) == F.col("_w"), "left_anti")


def merged_by_key(rows: DataFrame, key: str, name: str, seq: str, sums: list[str]) -> DataFrame:
    """One row a key: the shortest name (then the first), how many rows, and sums."""
    return rows.groupBy(key).agg(F.min_by(name, F.struct(F.length(name), F.col(seq))).alias(name), F.count(F.lit(1)).alias("n_rows"), *[F.sum(s).alias(s) for s in sums])


def overlay(current: DataFrame, layers: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The value of the first layer that has the key, and its name; blocked if none."""
    out = current
    for name, layer in layers:
        out = out.join(layer.select(key, F.col(value).alias(f"_{name}")), key, "left")
    source = F
    for name, _ in layers:
        source = source.when(F.col(f"_{name}").isNotNull(), name)
    out = out.withColumn(value, F.coalesce(*[f"_{n}" for n, _ in layers])).withColumn("provenance", source.otherwise("blocked"))
    return out.drop(*[f"_{n}" for n, _ in layers])


def many_by_label(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Each row with the sorted names (of labels: key, name) that belong to its key, which are one, many or none."""
    names = labels.groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("names"))
    return rows.join(names, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def missing_and_invented(truth: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """The keys that only one side has, and of which kind they are."""
    both = truth.select(key, F.lit(True).alias("_t")).distinct().join(got.select(key, F.lit(True).alias("_g")).distinct(), key, "full_outer")
    return both.where("_t is null or _g is null").select(key, F.when(F.col("_g").isNull(), "missing").otherwise("invented").alias("kind"))
