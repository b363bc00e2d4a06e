"""From raw documents to packed training sequences.

Stages run in order; each reads what the one before it wrote. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import packing, pu_classifier, quality_rules, secrets, simhash_similar
from riskloom.llm.frames import table
from riskloom.plans.staging import fresh_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules hold to be good."""
    return quality_rules.good_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned score accepts."""
    return pu_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and those of no group.

    Near are texts of which 0.8 of the shingles of five words, or more, are shared. Every link is verified on
    whole texts, and no group is cut."""
    return simhash_similar.one_of_each(docs)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the name of their kind."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that fill the training sequences, with their token ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", simhash_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("mixture_packing", packing_stage),
]

#: models, near-duplicate groups and packing have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
