"""Feeds, digests and nested items on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import readmodels as R
from quillon.operators import views as V


def test_items_and_digest(spark):
    articles = spark.createDataFrame([(1, "a", "T1", 80.0, dt.date(2025, 1, 2), "other"), (2, "b", "T2", 10.0, dt.date(2025, 1, 3), "other"), (3, "a", "T3", 90.0, dt.date(2025, 1, 3), "other")], "article long, lab string, title string, score double, published_on date, doc_type string")
    tags = spark.createDataFrame([(1, 1, "m2", "high", "high"), (1, 0, "m1", "low", "high")], "article long, ordinal int, mechanism string, magnitude string, confidence string")
    links = spark.createDataFrame([(2, "I", "named", "name:Intel", "mixed", 0.3), (2, "I", "exposure", "a:equity", "mixed", 0.1)], "article long, isin string, route string, via string, direction string, strength double")
    groups = spark.createDataFrame([(1, 1, 2), (3, 1, 2), (2, 2, 1)], "article long, group_id long, size long")
    labs = spark.createDataFrame([("a", "Alpha")], "lab string, label string")
    items = R.items(articles, tags, links, groups, labs)
    by_id = {r.article: r for r in items.collect()}
    assert [t.mechanism for t in by_id[1].tags] == ["m1", "m2"] and by_id[2].tags == [] and by_id[2].lab_label == "b"
    assert {c.label for c in by_id[2].connections} == {"Named: Intel", "Exposure to a"} and (by_id[2].rank_value, by_id[2].rank_min) == (30.0, 10.0)
    assert [r.article for r in R.visible(items, isin="I").collect()] == [2] and [r.article for r in R.visible(items, lab="a").collect()] == [3, 1]
    assert {(r.facet, r.value, r.n) for r in R.facets(items).collect()} == {("lab", "a", 2), ("lab", "b", 1), ("holding", "I", 1)}
    day = lambda n: F.lit(f"2025-01-0{n}").cast("date")
    shown, stats = R.digest(items, "group_id", F.col("rank_value") >= 50, day(1), day(3), 5)
    assert [r.article for r in shown.collect()] == [3]
    s = stats.first()
    assert (s.considered, s.matched_rule, s.collapsed, s.surfaced, s.suppressed) == (2, 1, 1, 1, 1)


def test_feeds_and_allocation(spark):
    users = spark.createDataFrame([("a", None), ("b", 2), ("c", 30), ("d", 60)], "user string, projected int")
    caps = {r.user: r.cap for r in V.allocation(users, 100, 40, 5, 5).collect()}
    assert caps == {"a": 40, "b": 5, "c": 30, "d": 40}
    rich = spark.createDataFrame([("a", None), ("b", 100), ("c", 300), ("d", 0)], "user string, projected int")
    assert {r.user: r.cap for r in V.allocation(rich, 200, 100, 5, 20).collect()} == {"a": 100, "b": 100, "c": 100}
    assert {r.user for r in V.allocation(rich, 0, 100, 5, 20).collect()} == {"a"}
    runs = spark.createDataFrame([(1, "ok", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1, 0, 1)), (2, "running", dt.datetime(2025, 1, 2), None)], "id long, status string, started_at timestamp, finished_at timestamp")
    got = V.described_runs(runs, F.lit("2025-01-02 00:00:30").cast("timestamp")).orderBy("id").collect()
    assert [(r.seconds, r.is_current) for r in got] == [(60, False), (30, True)]
    snaps = spark.createDataFrame([(i, "v") for i in range(5)], "id long, prompt_version string")
    assert [r.id for r in V.drift_history(snaps, "v", 2).collect()] == [3, 4]
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id long, name string")
    evidence = spark.createDataFrame([(2, "https://x.org/annex")], "person_id long, ref_url string")
    assert [r.id for r in V.register_view(people, evidence, "ANN").collect()] == [1, 2] and V.register_view(people, evidence, " ").count() == 0


def test_survey_counts(spark):
    from quillon.operators import aggregates as A

    told = spark.createDataFrame([("a",), ("b",), ("a",)], "lab string")
    papers = spark.createDataFrame([("a", ["MIT", "Google DeepMind"]), ("a", ["MIT"]), ("b", ["MIT", "ETH", "Fairfield"]), ("b", ["CMU"]), ("b", None)], "lab string, affiliations array<string>")
    by_lab, counts, commonest = A.survey_counts(told, papers, top=2)
    assert sorted(map(tuple, by_lab.collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, counts.collect())) == [("a", "Google DeepMind", 1), ("a", "MIT", 2), ("b", "CMU", 1), ("b", "ETH", 1), ("b", "Fairfield", 1), ("b", "MIT", 1)]
    assert [tuple(r) for r in commonest.collect()] == [("MIT", 3), ("CMU", 1)]
