"""Golden examples and invariants of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregates as A
from quillon.operators import alerts as L
from quillon.operators import dml
from quillon.operators import evaluation as E
from quillon.operators import graph as G
from quillon.operators import incremental as I
from quillon.operators import joins as J
from quillon.operators import quality as V
from quillon.operators import readmodels as R
from quillon.operators import scalar_filters as S
from quillon.operators import topk as K
from quillon.operators import windows as W


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_named_route(spark):
    holdings = spark.createDataFrame([("I1", "Intel Corp", ["x86"], "INTC"), ("I2", "MU Inc", None, "MU"), ("I3", "Tera Ltd", ["AWS"], "WULF")], "isin string, name string, aliases array<string>, ticker string")
    articles = spark.createDataFrame([(1, "artificial intelligence MU"), (2, "a deal with Intel today, INTC"), (3, "WULF and aws"), (4, "WULF only wulf"), (5, "X86 chips")], "article long, text string")
    assert rows(J.named_route(articles, holdings).select("article", "isin", "via", "direction", "strength")) == [
        (2, "I1", "name:Intel", "mixed", 0.3), (3, "I3", "alias:AWS", "mixed", 0.3), (4, "I3", "ticker:WULF", "mixed", 0.3), (5, "I1", "alias:x86", "mixed", 0.3)]


def test_contradictions_and_best(spark):
    c = spark.createDataFrame([(1, "A", "mechanism", "m", "positive", 0.5), (1, "A", "category", "c", "negative", 0.2), (1, "B", "category", "c", "negative", 0.2), (2, "A", "category", "c", "mixed", 0.2)], list(J.CONNECTION))
    assert len(rows(J.drop_contradicted(c))) == 3
    best = J.union_best([c, c.withColumn("strength", F.lit(0.5))], ["article", "isin", "route", "via"])
    assert {r.strength for r in best.collect()} == {0.5} and best.count() == 4


def test_band_pairs_match_brute_force(spark):
    import random

    rng = random.Random(1)
    data = [(i, rng.choice("ab"), day(rng.randint(0, 40))) for i in range(120)]
    got = rows(J.band_pairs(spark.createDataFrame(data, "k long, lab string, d date"), "k", ["lab"], "d", 5).select("a", "b", "gap"))
    assert got == sorted(((a[0], b[0], abs((a[2] - b[2]).days)) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and abs((a[2] - b[2]).days) <= 5), key=repr)


def test_as_of(spark):
    closes = spark.createDataFrame([("x", day(0), 10.0), ("x", day(3), 11.0), ("x", day(4), 12.0)], "s string, w date, close double")
    wanted = spark.createDataFrame([("x", day(3)), ("x", day(-1)), ("y", day(9))], "s string, at date")
    assert rows(J.as_of(wanted, closes, ["s"], "at", "w", ["close"], "close").select("s", "at", "close")) == sorted([("x", day(3), 11.0), ("x", day(-1), None), ("y", day(9), None)], key=repr)


@pytest.mark.parametrize("repo_days, sizes", [([("r", 1), ("r", 2), ("r", 3)], [3]), ([("r", 1), ("s", 1)], [1, 1]), ([("r", 1), ("r", 2), ("r", 20)], [1, 2]), ([("r", d) for d in range(1, 6)], [5]), ([("r", d) for d in range(0, 32)], [2, 15, 15])])
def test_release_trains(spark, repo_days, sizes):
    df = spark.createDataFrame([(r, i, d) for i, (r, d) in enumerate(repo_days)], "repo string, id long, d long")
    out = W.capped_sessions(df, ["repo"], F.col("d"), "id", 2, 14)
    assert sorted(r.n for r in out.groupBy("repo", "train").agg(F.count(F.lit(1)).alias("n")).collect()) == sizes


def test_rank_and_anchor(spark):
    df = spark.createDataFrame([("A", 100, 67), ("B", 40, 100), ("C", 100, 17), ("D", 80, 80)], "k string, e int, h int")
    hi, lo = W.rank_key("e", "h")
    assert [r.k for r in df.orderBy(F.desc(hi), F.desc(lo), "k").collect()] == ["A", "B", "C", "D"]
    group = spark.createDataFrame([(1, "g", 100.0, day(2)), (2, "g", 100.0, day(0)), (3, "g", 5.0, day(9))], "k long, g string, s double, d date")
    assert W.anchors(group, "g", "s", "d", "k").first().k == 2 and W.anchors(group, "g", "s", "d", "k", latest=True).first().k == 1


def test_scores(spark):
    items = spark.createDataFrame([(1, 5.0), (2, 2.0), (3, 5.0)], "k long, w double")
    tags = spark.createDataFrame([(1, "high", "high"), (2, "medium", "high"), (1, "low", "low")], "k long, magnitude string, confidence string")
    assert rows(A.event_scores(items, tags, "k", F.col("w")).select("k", "score")) == [(1, 100.0), (2, 26.7), (3, 0.0)]


def test_prices_verify(spark):
    s = lambda prices: spark.createDataFrame([("x", f"q{i}", p, t) for i, (p, t) in enumerate(prices)], "g string, p string, ours double, theirs double")
    check = lambda prices: W.verify_prices(s(prices), "g", "p", "ours", "theirs").first()
    assert check([(10.0, 10.0)] * 5).ok and check([(10.0, 10.0)] * 5).checked == 4
    bad = check([(10.0, 10.0)] * 3 + [(10.0, 10.5)])
    assert not bad.ok and bad.worst_at == "q3"
    split = check([(100.0, 10.0)] + [(10.0, 10.0)] * 4)
    assert split.ok and split.jump == "q0"


def test_moves(spark):
    people = spark.createDataFrame([(1, "paper", "n", "a", day(0), day(5)), (2, "paper", "n", "b", day(3), day(9)), (3, "github", "h", "a", day(0), day(1)), (4, "github", "h", "b", day(5), day(6))], "id long, source_kind string, name string, lab string, first_seen date, last_seen date").withColumnRenamed("source_kind", "kind")
    evidence = spark.createDataFrame([(3, "u", "confirmed")], "person_id long, ref_url string, tier string")
    got = A.moves(people, evidence).collect()
    assert [(r.name, r.direction, r.gap_days) for r in got] == [("n", "a -> b", -2)]


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)], "a long, b long")
    got = {r.node: r.root for r in G.components(edges).collect()}
    assert got[3] == 1 and got[5] == 4 and got[159] == 100 and got[240] == 200 and 9 not in got
    assert G.components(edges.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 50)], "alias long, target long")
    assert {r.target for r in G.collapse_chains(chain).collect()} == {0}


def test_account_aliases(spark):
    accounts = spark.createDataFrame([("ann", 5, ["a@x.org"]), ("ann2", 9, ["a@x.org", "1@users.noreply.github.com"]), ("bob-work", 1, []), ("bob", 3, ["1@users.noreply.github.com"])], "login string, commits int, emails array<string>")
    assert rows(G.alias_pairs(accounts, "-work$")) == [("ann", "ann2"), ("bob-work", "bob")]


def test_upsert_converges(spark):
    old = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "h2")], "url string, d int, hash string")
    new = spark.createDataFrame([("a", 2, "h9"), ("a", 3, "h3"), ("c", 1, "h4"), ("b", 1, "h2")], "url string, d int, hash string")
    merged, counts = dml.upsert(old, new, "url", "d", "hash")
    assert rows(merged) == [("a", 3, "h3"), ("b", 1, "h2"), ("c", 1, "h4")] and tuple(counts.first()) == (1, 1, 1, 0, 3)
    assert tuple(dml.upsert(merged, new, "url", "d", "hash")[1].first()) == (0, 0, 3, 0, 3)


def test_periods_partition_time(spark):
    df = spark.createDataFrame([(day(n),) for n in range(30)], "d date")
    out = I.by_period(df, "d", 3).collect()
    assert all(r.period_end >= r.d > r.period_end - dt.timedelta(days=3) for r in out)
    published = spark.createDataFrame([(day(0),), (day(2),)], "period_end date")
    got = I.missing_periods(published, F.lit(str(day(6))).cast("date"), 1).collect()
    assert [(r.period_end, r.publish_at) for r in got] == [(day(3), day(4)), (day(4), day(5))]
    assert I.missing_periods(published, F.lit(str(day(4))).cast("date"), 1).count() == 0
    assert I.missing_periods(published.limit(0), F.lit(str(day(4))).cast("date"), 1).count() == 0


def test_state(spark):
    ev = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 5, True)], "k string, at int, ok boolean")
    assert rows(I.failure_streaks(ev, "k", "at", "ok").select("k", "consecutive_failures")) == [("a", 2), ("b", 1), ("c", 0)]
    state = spark.createDataFrame([("a", 0), ("z", 4)], "k string, watermark int")
    assert dict(rows(I.advanced_watermarks(state, ev, "k", "at"))) == {"a": 0, "b": None, "c": 5, "z": 4}
    seen = spark.createDataFrame([("x", None), ("y", dt.datetime(2025, 1, 1))], "dedupe_key string, acknowledged_at timestamp")
    cand = spark.createDataFrame([("x",), ("y",), ("w",), ("w",)], "dedupe_key string")
    assert rows(I.dispatch(cand, seen)) == [("w", "new"), ("x", "known"), ("y", "reopen")]
    assert I.run_isolated({"a": lambda: 1, "b": lambda: 1 / 0, "c": lambda: 3})["c"] == 3


def test_evaluation(spark):
    sets = spark.createDataFrame([(["a", "b"], ["a"]), ([], [])], "r array<string>, g array<string>")
    got = E.axis(sets, "r", "g").first()
    assert (got.tp, got.fp, got.fn, got.identical) == (1, 0, 1, 1) and got.macro_f1 == round((2 / 3 + 1) / 2, 6)
    labels = spark.createDataFrame([("x", "x")] * 5, "a string, b string")
    assert E.kappa(labels, "a", "b").first().kappa == 1.0
    assert E.median_level(spark.createDataFrame([("g", "low"), ("g", "high")], "g string, l string"), ["g"], "l").first().l == "low"
    tags = spark.createDataFrame([(1, "t", "x"), (1, "u", "x"), (1, "v", "x")], "k int, t string, v string")
    verdicts = spark.createDataFrame([(1, "t", "drop", None), (1, "u", "adjust", "y"), (1, "w", "add", "z")], "k int, t string, verdict string, v string")
    assert rows(E.apply_verdicts(tags, verdicts, "k", "t", "v")) == [(1, "u", "y"), (1, "v", "x"), (1, "w", "z")]
    assert rows(E.migrate_tags(tags.withColumn("v", F.lit("positive")), "t", "v", {"t": ("n", True)}, ["u"]).select("t", "v", "reason")) == [("n", "negative", None), ("u", "positive", "retired: u"), ("v", "positive", None)]
    assert rows(E.compare_bylines(spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "article string, name string, position int"), spark.createDataFrame([("p", "b", 1), ("p", "c", 2)], "article string, name string, position int"), []).select("matched", "missed", "invented")) == [(1, 1, 1)]


def test_alert_rules(spark):
    states = spark.createDataFrame([("s", 3, dt.datetime(2025, 1, 1), False, dt.datetime(2024, 12, 1)), ("t", 3, None, True, None)], "source_id string, consecutive_failures int, last_success_at timestamp, disabled boolean, watermark timestamp")
    snaps = spark.createDataFrame([(1, 0.9), (2, 0.4)], "id long, f1 double")
    runs = spark.createDataFrame([(7, "failed", None), (8, "ok", None)], "id long, status string, alerted_at timestamp")
    got = L.evaluate([L.source_down(states, 3), L.drift(snaps, 0.5, "v9"), L.run_failed(runs), L.watermark_stalled(states, 7)]).collect()
    assert [r.rule for r in got] == ["drift", "run_failed", "source_down", "watermark_stalled"] and got[0].dedupe_key == "drift:v9:since:1"


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "", 5)], "k int, f string, g int")
    found = V.violations([V.unique(df, ["k"], "u"), V.required(df, "k", ["f"], "r"), V.exactly_one(df, "k", ["f", "g"], "e")])
    assert rows(found.groupBy("check").count()) == [("e", 1), ("r", 1), ("u", 1)]


def test_lists_and_filters(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "k int, v double")
    assert [r.k for r in K.capped_digest(df, [F.desc("v")], [F.asc("k")], 2).collect()] == [3, 4]
    assert K.clamp(0, 9) == 1 and K.clamp(99, 9) == 9
    assert R.search(df.withColumn("t", F.lit("Abc")), "k", ["t"], " bC ", 2).count() == 2 and R.search(df, "k", ["k"], "  ", 2).count() == 0
    bots = spark.createDataFrame([(x,) for x in ("dependabot[bot]", "bot-x", "my-bot", "Copilot", "alice")], "l string")
    assert [r.b for r in bots.select(S.is_bot(F.col("l")).alias("b")).collect()] == [True, True, True, True, False]
    line = A.apportion(spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long"), "k", "n", 3)
    assert sum(r.seats for r in line.collect()) == 3
    spread = A.holdings_line(spark.createDataFrame([(1, "A", 0.1), (1, "A", 0.9), (1, "B", 0.5)], "k int, isin string, strength double"), "k", 1).first()
    assert spread.named == ["A"] and spread.others == 1
    tail = G.recommend_band(G.threshold_curve(spark.createDataFrame([(0.9, True), (0.2, False), (0.6, True)], "s double, t boolean"), "s", "t", [0.1, 0.5, 0.95])).first()
    assert (tail.high, tail.low) == (0.5, 0.5)


def test_swaps_survive_a_crash_at_each_step(spark, tmp_path):
    import os
    import shutil

    from quillon.streaming.jobs import upserting

    path = str(tmp_path / "t")
    rows = lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    batch = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id long, v long")
    write = upserting(path, "id", "v", batch(1).schema)
    write(batch(1, 2), 0)
    batch(9).write.parquet(f"{path}.new")  # before the renames
    write(batch(3), 1)
    assert rows() == [1, 2, 3]
    os.rename(path, f"{path}.old")  # between them, with or without the new table
    write(batch(4), 2)
    assert rows() == [1, 2, 3, 4]
    os.rename(path, f"{path}.old")
    batch(1, 2, 3, 4, 5).write.parquet(f"{path}.new")
    assert dml.recover(spark, path) and rows() == [1, 2, 3, 4]
    shutil.copytree(path, f"{path}.old")  # after them, before the old table goes
    write(batch(5), 3)
    assert rows() == [1, 2, 3, 4, 5] and not os.path.exists(f"{path}.old") and not dml.recover(spark, str(tmp_path / "none"))


def test_moves_need_employment_on_every_side(spark):
    people = spark.createDataFrame([(1, "github", "h", "a", day(0), day(1)), (2, "github", "h", "b", day(5), day(6))], "id long, kind string, name string, lab string, first_seen date, last_seen date")
    for tiers, n in ((("unknown", "unknown"), 0), (("confirmed", "handle"), 0), (("confirmed", "confirmed_org_wide"), 1)):
        evidence = spark.createDataFrame([(k + 1, "u", t) for k, t in enumerate(tiers)], "person_id long, ref_url string, tier string")
        assert A.moves(people, evidence).count() == n
        overview = A.register_overview(people.withColumnRenamed("kind", "source_kind"), evidence)
        assert sum(r.evidenced for r in overview.collect()) == sum(t.startswith("confirmed") for t in tiers)


def test_employment_and_its_later_tiers(spark):
    c = F.col
    rows = [(1, False, 0, False, "confirmed"), (1, True, 2, True, "confirmed_org_wide"), (0, True, 1, True, "vendor"), (0, False, 0, True, "handle"), (0, False, 0, False, "unknown")]
    df = spark.createDataFrame(rows, "corp int, shared boolean, vendor int, handle boolean, want string").withColumn("tier", A.employment(c("corp"), c("shared"), c("vendor"), c("handle")))
    assert all(r.tier == r.want for r in df.collect())
    cases = [("confirmed", True, True, "confirmed"), ("handle", True, False, "profile"), ("handle", False, True, "handle"), ("vendor", False, True, "deleted"), ("unknown", False, False, "unknown")]
    df = spark.createDataFrame(cases, "tier string, company boolean, missing boolean, want string").withColumn("now", A.retiered(c("tier"), c("company"), c("missing")))
    assert all(r.now == r.want for r in df.collect())


def test_alias_verdicts(spark):
    names = [("Ann Lee", "ann"), ("Ann. Lee", "ann"), ("Annie Lee", "annie"), ("A Lee", "a"), ("Bob Lee", "bob")]
    df = spark.createDataFrame([(n, g, "lee") for n, g in names], "name string, given string, family string")
    co = spark.createDataFrame([("Ann Lee", ["x", "y", "z"]), ("Annie Lee", ["x", "y", "z", "q"]), ("Ann. Lee", ["k"])], "name string, others array<string>")
    appears = spark.createDataFrame([("Ann. Lee", ["p"]), ("Annie Lee", ["p"])], "name string, articles array<string>")
    got = {(r.name_a, r.name_b): r.verdict for r in G.alias_proposals(df, co, appears).collect()}
    assert got == {("Ann Lee", "Ann. Lee"): "same_string", ("Ann Lee", "Annie Lee"): "likely_same", ("Ann. Lee", "Annie Lee"): "reject"}


def test_half_even_rounding_on_the_binary_value(spark):
    from quillon.functions.maths import round_binary

    values = [0.5, 1.5, 2.5, 2.675, 1.005, -0.125, 0.125, 1e300, None]
    got = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", round_binary(F.col("v"), 2).alias("r")).orderBy("i").collect()]
    assert got == [None if v is None else round(v, 2) for v in values]


def test_named_route_by_words(spark):
    texts = [(1, "Nvidia Corp. and C++ rule"), (2, "the AMD chip, not amd"), (3, "renvidia"), (4, None)]
    holdings = [("a", "NVIDIA Corporation", ["c++"], None), ("b", "Advanced Micro", None, "AMD"), ("c", None, ["+++"], "amd")]
    from quillon.operators import joins as J

    got = J.named_route(spark.createDataFrame(texts, "article int, text string"), spark.createDataFrame(holdings, "isin string, name string, aliases array<string>, ticker string")).collect()
    assert sorted((r.article, r.isin, r.via.split(":")[0]) for r in got) == [(1, "a", "name"), (2, "b", "ticker"), (2, "c", "ticker")]



MODELS = [
    (1, "a", "tooling", "a/x", ["gpt-6-astra"], 0), (2, "a", "release", None, ["gpt-6-astra"], 3), (3, "a", "release", "", ["gpt-6"], 14), (4, "a", "story", None, ["gpt-6"], 0),
    (5, "b", "release", None, ["gpt-6-astra"], 0), (6, "a", "release", None, ["gpt-6"], 15), (7, "a", "tooling", "a/y", ["gpt-6-astra"], 1), (8, "a", "tooling", "a/z", ["m-1", "m-2", "m-3", "gpt-6"], 0),
    (9, "c", "tooling", "c/x", ["deepseek-v4", "deepseek-r2"], 0), (10, "c", "release", None, ["deepseek-v4", "deepseek-r2"], 0),
]


def test_releases_link_to_the_announcements_of_their_models(spark):
    table = spark.createDataFrame([(*r[:5], day(r[5])) for r in MODELS], "id int, lab string, event_type string, repo string, models array<string>, day date")
    want = [(1, 2, "gpt-6-astra"), (1, 3, "gpt-6"), (7, 2, "gpt-6-astra"), (7, 3, "gpt-6"), (7, 6, "gpt-6"), (9, 10, "deepseek-r2")]
    assert sorted(map(tuple, J.release_links(table, ["release"], 14).collect())) == want
    assert J.release_links(table.limit(0), ["release"], 14).count() == 0


@pytest.mark.parametrize("most", [100, 2])
def test_words_that_no_text_contains(spark, most):
    words = spark.createDataFrame([("Abc",), ("bcd",), ("x",), ("zz",), ("",), (None,), ("cdef",), ("ccc",)], "w string")
    texts = spark.createDataFrame([("xABCDE",), (None,), ("",), ("cdeg",)], "t string")
    assert rows(J.not_contained(words, texts, "w", "t", most)) == [("ccc",), ("cdef",), ("zz",), (None,)]


def test_titles_resolve_by_title_then_by_description(spark):
    wanted = spark.createDataFrame([(1, "Large Models, Scaled", "d"), (2, "Sparse attention kernels", "d"), (3, "HyperAgents", "agents that modify themselves"), (4, "Nothing", "nothing known")], "id int, title string, description string")
    kind = "id int, seq int, cand string, cand_title string, summary string"
    exact = spark.createDataFrame([(1, 1, "p", "Other models", ""), (1, 2, "q", "large models scaled", ""), (2, 1, "r", "Sparse attention kernels revisited", ""), (3, 1, "s", "Unrelated work", "")], kind)
    relaxed = spark.createDataFrame([(3, 1, "t", "x", "weather"), (3, 2, "u", "y", "agents modify code"), (3, 3, "v", "z", "agents modify code"), (4, 1, "w", "w", "weather")], kind)
    assert rows(G.resolve_titles(wanted, exact, relaxed)) == [(1, "q", "exact_title"), (2, "r", "exact_title"), (3, "u", "relaxed_title")]


def test_differences_say_what_they_would_change(spark):
    base = spark.createDataFrame([(1, "t", 2.0), (1, "u", 5.0), (1, "x", 1.0), (2, "t", 1.0)], "k int, t string, v double")
    other = spark.createDataFrame([(1, "t", 7.0), (1, "x", 0.5), (2, "t", 1.0), (3, "t", 4.0)], "k int, t string, v double")
    best = lambda v: F.coalesce(F.array_max(v), F.lit(0.0))
    got = E.label_impact(base, E.label_diff(other, base, "k", "t", "v"), "k", "t", "v", best)
    assert rows(got.select("k", "t", "kind", "impact")) == [(1, "t", "differs", 2.0), (1, "u", "only_b", -3.0), (1, "x", "differs", 0.0), (3, "t", "only_a", 4.0)]
