"""A training corpus from raw documents: five stages, each written and read again.

A stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return
the columns of ``documents``.  Toxic documents go, one document of each
group of near copies stays, documents with benchmark passages go, secrets
are replaced in the texts, and the rest is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.common import table
from webloom.llm.decontaminate import clean_documents
from webloom.llm.packing import pack_documents
from webloom.llm.secrets import redact
from webloom.llm.simhash import MAX_BITS, SHINGLE, one_of_each
from webloom.llm.toxicity import without_toxic
from webloom.session import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, SHINGLE, MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("packing", packing),
]

# The classifier, XXH64 and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read by the next."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
