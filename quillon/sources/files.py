"""Readers of the corpus's file formats; everything goes through Spark's own readers, so any file system works."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import german_number, is_isin, strip_tags


def cache_key(url: Column) -> Column:
    """The file name under which a page's answer is kept."""
    return F.concat(F.substring(F.regexp_replace(url, "[^A-Za-z0-9]+", "_"), 1, 140), F.lit(".json"))


def json_array(spark: SparkSession, path: str, schema: str, source: str, limit: int | None = None) -> DataFrame:
    """A file that is one array of records, with where they came from."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("source_file", F.lit(source))
    return rows.limit(limit) if limit else rows


def keyed_folder(spark: SparkSession, path: str, schema: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers for the wanted urls by file name, and the urls without one."""
    files = spark.read.schema(schema).json(path, multiLine=True).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    keyed = wanted.withColumn("_file", cache_key(F.col("url")))
    return keyed.join(files, "_file").drop("_file"), keyed.join(files.select("_file"), "_file", "left_anti").drop("_file")


def json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """S3: an append-only log: good rows, and bad lines as text."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad"), parsed.where("r is null or r._bad is not null").select("value")


def verdicts(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New verdicts whose relevant field is a boolean, and those whose isn't. rows: key, relevant (text)."""
    flag = F.when(F.lower("relevant") == "true", True).when(F.lower("relevant") == "false", False)
    rows = rows.withColumn("_f", flag)
    good = rows.where("_f is not null").join(known.select(key), key, "left_anti").withColumn("relevant", F.col("_f")).drop("_f")
    return good, rows.where("_f is null").drop("_f")


def yaml_rows(spark: SparkSession, text: str, entry: str, schema: str) -> DataFrame:
    """A list inside a small configuration text as a table."""
    import yaml

    fields = [part.split()[0] for part in re.split(r",(?![^<]*>)", schema)]
    data = yaml.safe_load(text)[entry]
    items = [{"id": k, **(v or {})} for k, v in data.items()] if isinstance(data, dict) else data
    return spark.createDataFrame([tuple(i.get(f) for f in fields) for i in items], schema)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Sitemaps, feeds, holdings filings, paper listings."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)


def sitemap(spark: SparkSession, path: str, cutoff: str, skip: str) -> DataFrame:
    """Addresses whose last change, if given, isn't before the cutoff. It can rule out, never date."""
    rows = xml_rows(spark, path, "url", "loc string, lastmod string")
    return rows.where(F.col("lastmod").isNull() | (F.substring("lastmod", 1, 10) >= cutoff)).where(~F.col("loc").rlike(skip))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of a feed's pages, each address once."""
    return xml_rows(spark, path, "item", "title string, link string, pubDate string, description string").dropDuplicates(["link"])


def holdings_filing(spark: SparkSession, path: str) -> DataFrame:
    """Positions; absent numbers are 0."""
    schema = "nameOfIssuer string, cusip string, value long, shrsOrPrnAmt struct<sshPrnamt:long>, putCall string"
    rows = xml_rows(spark, path, "infoTable", schema)
    return rows.select(F.col("nameOfIssuer").alias("issuer"), "cusip", F.coalesce("value", F.lit(0)).alias("value_usd"), F.coalesce("shrsOrPrnAmt.sshPrnamt", F.lit(0)).alias("shares"), F.col("putCall").alias("put_call"))


def split_and_merge(rows: DataFrame) -> DataFrame:
    """Common positions and options apart, one row per number, in percent of the common total."""
    kind = F.when(F.col("put_call").isNull(), "common").otherwise("option")
    sums = rows.groupBy(kind.alias("kind"), "cusip").agg(F.min("issuer").alias("issuer"), F.sum("value_usd").alias("value_usd"), F.sum("shares").alias("shares"))
    total = sums.where("kind = 'common'").agg(F.sum("value_usd").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.try_divide("value_usd", "_t"), 4)).drop("_t")


def position_records(lines: DataFrame, unit: str, back: int) -> DataFrame:
    """Report lines (report, line, text): at each ISIN walk back to the nearest unit marker within so many lines.

    The walk is a window over the few lines before, so no report is held whole."""
    from pyspark.sql import Window

    code = F.regexp_extract("text", r"\b([A-Z]{2}[A-Z0-9]{9}[0-9])\b", 1)
    before = Window.partitionBy("report").orderBy("line").rowsBetween(-back, 0)
    packed = F.struct("line", "text")
    rows = lines.withColumn("isin", code).withColumn("_unit", F.last(F.when(F.col("text").rlike(unit), packed), ignorenulls=True).over(before))
    rows = rows.withColumn("_prior", F.collect_list(packed).over(before))
    span = F.transform(F.filter("_prior", lambda x: x["line"] >= F.col("_unit.line")), lambda x: x["text"])
    return rows.where(is_isin(F.col("isin")) & F.col("_unit").isNotNull()).select("report", "line", "isin", F.array_join(span, " ").alias("record"))


def reconcile(records: DataFrame, stated: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A report's parsed total against the one it states. records: report, value (German number); stated: report, total."""
    sums = records.groupBy("report").agg(F.sum(german_number(F.col("value"))).alias("parsed"))
    return stated.join(sums, "report", "left").withColumn("ok", F.abs(F.col("parsed") / F.col("total") - 1) <= tolerance)


def layout_lines(runs: DataFrame) -> DataFrame:
    """Text runs (page, x, y, text) into lines: rows of about one height, from left to right."""
    line = F.round(F.col("y") / 3).cast("long")
    packed = F.sort_array(F.collect_list(F.struct("x", "text")))
    return runs.groupBy("page", line.alias("row")).agg(F.array_join(F.transform(packed, lambda r: r["text"]), " ").alias("line"))


def sections(lines: DataFrame, headers: list[str]) -> DataFrame:
    """Each line with the header that it stands under; rows go down a page from the greatest height."""
    from pyspark.sql import Window

    below = Window.partitionBy("page").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col("line").isin(*headers), F.col("line")), ignorenulls=True).over(below))


def listing(rows: DataFrame, cutoff: str) -> DataFrame:
    """Own, live repositories that were pushed to since (times compare as text)."""
    return rows.where(~F.col("fork") & ~F.col("archived") & (F.col("pushed_at") >= cutoff))


def flat_commits(pages: DataFrame) -> DataFrame:
    """Nested history pages (org, repo, nodes) into commits."""
    each = pages.select("org", "repo", F.explode("nodes").alias("c"))
    return each.select("org", "repo", F.col("c.author.user.login").alias("login"), F.col("c.author.name").alias("name"), F.col("c.author.email").alias("email"), F.substring("c.committedDate", 1, 10).alias("date"))


def model_index(listed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Identifiers that the committed baseline lacks; an empty listing is an error, as nothing would seem new."""
    guard = listed.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("the index has no entries")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return listed.join(baseline.select("id"), "id", "left_anti").crossJoin(F.broadcast(guard)).where("_ok").drop("_ok")


def register_paged_source(spark: SparkSession, name: str, schema: str, fetch: Callable[[dict, int], list[tuple]], max_pages: int) -> None:
    """A batch data source over a paged service. fetch(options, page) gives rows; a page without any
    ends a channel. Channels (the option channels, comma-separated) are read by tasks of their own."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Channel(InputPartition):
        def __init__(self, name: str):
            self.name = name

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = dict(options)

        def partitions(self):
            return [Channel(c) for c in self.options.get("channels", "all").split(",")]

        def read(self, partition) -> Iterator[tuple]:
            for page in range(1, max_pages + 1):
                rows = fetch({**self.options, "channel": partition.name}, page)
                if not rows:
                    return
                yield from rows

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002  the engine passes it by name
            return Reader(self.options)

    spark.dataSource.register(Paged)


def pages_as_rows(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Binary files through a parser, file by file. files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in re.split(r",(?![^<]*>)", schema)]
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(parse(content), columns=[c.strip() for c in columns])

    return files.mapInPandas(run, schema)


def link_rows(pages: DataFrame, pattern: str) -> DataFrame:
    """The links of listing pages (url, html) that a pattern accepts, with their text; each once."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))
    each = pages.select("url", F.explode(found).alias("a"))
    out = each.select("url", F.regexp_extract("a", r"(?i)href=[\"']([^\"']+)", 1).alias("link"), F.trim(F.regexp_replace(strip_tags(F.col("a")), r"\s+", " ")).alias("title"))
    return out.where(F.col("link").rlike(pattern)).dropDuplicates(["link"])
