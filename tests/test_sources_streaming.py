"""Readers over small files, and streams against their batch forms."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import windows as W
from quillon.sources import files, sinks
from quillon.streaming import jobs


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u", "text": "t"}, {"url": "v"}]))
    got = files.json_array(spark, str(tmp_path / "a.json"), "url string, text string", "src").collect()
    assert [(r.url, r.text, r.source_file) for r in got] == [("u", "t", "src"), ("v", None, "src")]
    (tmp_path / "log.jsonl").write_text('{"url": "a", "usd": 1.5}\nnot json\n\n{"url": "b", "usd": 2}\n')
    good, bad = files.json_log(spark, str(tmp_path / "log.jsonl"), "url string, usd double")
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["not json"]
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x/a</loc><lastmod>2025-01-02T00</lastmod></url><url><loc>https://x/tag/b</loc></url><url><loc>https://x/c</loc><lastmod>2024-01-01</lastmod></url></urlset>")
    assert [r.loc for r in files.sitemap(spark, str(tmp_path / "s.xml"), "2025-01-01", "/tag/").collect()] == ["https://x/a"]
    (tmp_path / "f.xml").write_text("<t><infoTable><nameOfIssuer>N</nameOfIssuer><cusip>C</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>3</sshPrnamt></shrsOrPrnAmt></infoTable><infoTable><nameOfIssuer>O</nameOfIssuer><cusip>D</cusip><putCall>Put</putCall></infoTable></t>")
    out = files.split_and_merge(files.holdings_filing(spark, str(tmp_path / "f.xml"))).collect()
    assert sorted((r.kind, r.cusip, r.value_usd, r.shares, r.pct) for r in out) == [("common", "C", 5, 3, 100.0), ("option", "D", 0, 0, 0.0)]


def test_keyed_folder_and_yaml(spark, tmp_path):
    (tmp_path / "https_x_org_a.json").write_text('{"event_type": "other"}')
    wanted = spark.createDataFrame([("https://x.org/a",), ("https://x.org/b",)], "url string")
    found, missing = files.keyed_folder(spark, str(tmp_path), "event_type string", wanted)
    assert [r.event_type for r in found.collect()] == ["other"] and [r.url for r in missing.collect()] == ["https://x.org/b"]
    rows = files.yaml_rows(spark, "labs:\n  a: {label: Alpha}\n  b:\n", "labs", "id string, label string").collect()
    assert [(r.id, r.label) for r in rows] == [("a", "Alpha"), ("b", None)]


def test_paged_source(spark):
    def fetch(options, page):
        return [(options["channel"], page)] if page <= 3 else []

    files.register_paged_source(spark, "pages_test", "channel string, page int", fetch, 10)
    assert spark.read.format("pages_test").option("channels", "a,b").load().count() == 6


def test_report_records(spark):
    lines = spark.createDataFrame([("r", 1, "Stück 5"), ("r", 2, "Some name"), ("r", 3, "US0378331005 1.234,50"), ("r", 4, "x")], "report string, line int, text string")
    assert files.position_records(lines, "Stück", 3).first().record == "Stück 5 Some name US0378331005 1.234,50"
    runs = spark.createDataFrame([(1, 9.0, 10.2, "b"), (1, 1.0, 9.9, "a")], "page int, x double, y double, text string")
    assert files.layout_lines(runs).first().line == "a b"


def test_merge_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    old = spark.createDataFrame([("a", "2025-01-01", "x")], "url string, date string, text string")
    new = spark.createDataFrame([("a", "2025-01-02", "y"), ("b", "2025-01-01", "z")], "url string, date string, text string")
    assert sinks.merge_corpus(old, new, path) == {"added": 1, "updated": 1, "unchanged": 0, "kept": 0, "total": 2}
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["y", "z"]


def run(query, name, spark):
    q = query.writeStream.format("memory").queryName(name).outputMode("update" if "streak" in name else "append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Some users fall silent half-way.
    half = events.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    events = events.where((F.col("user_id") % 3 != 0) | (F.unix_micros(F.col("ts").cast("timestamp")) < half))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = jobs.file_stream(spark, str(tmp_path / "e"), events.schema)
    flat = stream.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), (F.col("event_type") != "error").alias("ok"))
    closed = run(jobs.capped_sessions(flat, "key", 172_800, 604_800, "1 hour"), "capped", spark)
    batch = W.capped_sessions(events.select("user_id", "event_id", "ts"), ["user_id"], F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), "event_id", 172_800, 604_800)
    trains = batch.join(events.select("event_id", "ts"), "event_id").groupBy("user_id", "train").agg(F.max(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("last"), F.count(F.lit(1)).alias("n"))
    latest = trains.agg(F.max("last")).first()[0]
    # The watermark closes a key's last session too, if its gap has passed.
    is_last = F.col("last") == F.max("last").over(Window.partitionBy("user_id"))
    over = trains.withColumn("is_last", is_last).where((~F.col("is_last")) | (F.col("last") + 172_800 + 3600 < latest))
    assert sorted((r.key, r.last_at, r.n) for r in closed.collect()) == sorted((r.user_id, r["last"], r.n) for r in over.collect())
    assert over.where("is_last").count() > 0
    streaks = {r.key: r.consecutive_failures for r in run(jobs.failure_streaks(flat, "key"), "streak", spark).collect()}
    from quillon.operators.incremental import failure_streaks

    want = failure_streaks(events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok")), "key", "at", "ok")
    assert streaks == {r.key: r.consecutive_failures for r in want.collect()}


def test_stream_periods_and_upserts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = jobs.file_stream(spark, str(tmp_path / "e"), events.schema)
    q = jobs.tumbling(stream, "ts", "1 day", "40 days", ["event_type"]).writeStream.format("memory").queryName("tumble").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumble").agg(F.sum("n")).first()[0] == events.count()
    target = str(tmp_path / "t")
    write = jobs.upserting(target, "user_id", "event_id", events.schema)
    for _ in range(2):
        write(events, 0)
    assert spark.read.parquet(target).count() == events.select("user_id").distinct().count()
