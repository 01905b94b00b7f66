"""Corpus pipeline: five stages from documents to packed sequences, each a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tilth.llm import language_id, packing, quality, secret_scan, simhash
from tilth.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores 0.3 or more; it learns from labels of these documents."""
    stats = quality.document_statistics(docs)
    return quality.keep_good(docs, quality.train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=0.3)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the models learnt from these documents accept as one of their languages."""
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: five-word shingles, similarity from 0.8."""
    return simhash.keep_first(docs, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2,048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing. Tests hold near-duplicates against all pairs, secrets and
#: packing's planner against plain versions; classifier and language ID are tested by held-out accuracy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
