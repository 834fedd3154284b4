"""From raw documents to token ids: quality, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes it as Parquet in the shared
folder and reads it back as the next stage's input, so a lost executor costs no earlier stage.
All stages but the last keep the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import exact_dedup, mixing, near_dedup, quality_model, queries
from marketloom.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled ones among them, does not reject."""
    return quality_model.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup.drop_copies(docs, 5, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a source's last document is cut after its budget."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes they decode to."""
    return queries.bpe_digests(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("mixing", mixture),
    ("byte_bpe", encoding),
]

#: The classifier's scores have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
