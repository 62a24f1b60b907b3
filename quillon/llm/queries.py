"""The opN_ queries over the synthetic tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import cotrain, dartminhash, decontam, html_extract, mixing, pii, quality_rules, secrets, tokens, warc
from quillon.llm.oracles import ORACLE_SQL  # noqa: F401
from quillon.llm.spans import count_kind, listed


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.dedup_classes(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _digest(spans, kinds: tuple[str, ...], base: int):
    """SHA-256 of the listed spans of the first kinds."""
    return F.sha2(listed(F.filter(spans, lambda x: x["kind"] < base), kinds), 256)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    counts = [count_kind(spans, k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])]
    return rows.select("doc_id", *counts, _digest(spans, secrets.KINDS, 3).alias("base_sha256"), listed(spans, secrets.KINDS).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.roundtrip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = cotrain.score(docs, _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "p_low", "p_toxic", "keep")


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return tokens.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    counts = [count_kind(spans, k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS[:4])]
    return rows.select("doc_id", *counts, _digest(spans, pii.KINDS, 4).alias("base_sha256"), listed(spans, pii.KINDS).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_secret_scans, op3_near_duplicates, op4_mix_sources, op5_html_extraction, op6_warc_revisits,
        op7_quality_classifier, op8_token_counts, op9_quality_rules, op10_personal_data,
    )
}
