"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes all that its predecessor kept, and its result is written as Parquet in the shared folder
before the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plaudit.llm.common import documents, written
from plaudit.llm.ngram_join import keep_one
from plaudit.llm.packing import packed
from plaudit.llm.quality_classifier import keep_good
from plaudit.llm.quality_rules import keep_clean
from plaudit.llm.secrets import redacted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(spark, docs, sf_dir)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    return keep_clean(spark, docs, sf_dir)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return keep_one(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    import public_tokenizers
    return packed(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# Trained models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(spark, docs, f"stage-{at + 1}")
    return docs
