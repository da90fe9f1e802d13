"""The corpus pipeline: documents to token ids, stage after stage, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tanpura.llm import bpe, grace, mixing, probminhash, quality
from tanpura.llm.common import drop, scratch
from tanpura.session import shared_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return grace.drop_exact_duplicates(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays."""
    return probminhash.drop_near_duplicates(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard by shard and shuffled within each: a row for each time that a document is taken."""
    return mixing.mixed_rows(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's tokens, and the digests of its ids and of what they decode to."""
    made = bpe.digests(bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded=True))
    return made.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mixing_to_weights),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: A trained classifier, sketches and BPE can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage stores for itself goes when its result is written, and so does its predecessor's result."""
    last, docs = None, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if last:
            drop(spark, last)
        last, docs = path, spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
