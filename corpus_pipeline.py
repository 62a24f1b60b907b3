"""Five stages from raw documents to a training mix; each writes Parquet that the next one reads.

Each stage takes all that its predecessor kept. All but the last return the columns of documents, whatever they are:
extra columns pass through unchanged, those named like an operator's results as well. Null and empty texts are kept
by the first four stages unless the classifier rejects them, as are rows of null id; an empty table stays empty; of
rows that are equal in id and text near-dedup keeps one. The last stage adds copy_no, size, source_size, target, copies
and taken, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import cotrain, dartminhash, decontam, mixing, secrets
from quillon.scratch import cut


def _apart(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns that an operator would replace under other names, and the columns that restore them."""
    new = {c: f"_own_{c}" for c in docs.columns if c in results}
    return docs.withColumnsRenamed(new), [F.col(new.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    rows, own = _apart(docs, ("p_text", "p_meta", "p_low", "p_toxic", "keep"))
    return cotrain.score(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the least id."""
    return dartminhash.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of a benchmark go."""
    rows, own = _apart(docs, ("n_words", "n_hit", "items", "spans", "contaminated"))
    marked = decontam.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col("contaminated")).select(*own)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text give way to a marker."""
    rows, own = _apart(docs, ("secret_spans",))
    return secrets.redact(rows).select(*own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes, with the document's columns, its words and its source's target."""
    mixed = mixing.mix(docs, carry=True).where("taken > 0")
    return mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix),
]
#: The classifier's stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
