"""From raw documents to packed training sequences: quality, near-duplicates, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from polyview.llm.common import table
from polyview.llm.packing import pack_documents
from polyview.llm.pii import pseudonymise_column
from polyview.llm.quality import keep_good
from polyview.llm.queries import WORDS
from polyview.llm.simhash import keep_one_of_each
from polyview.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules; the columns stay."""
    return keep_good(docs, table(spark, folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; the columns stay.

    Three-word shingles and at most two differing bits, as in the registered query.
    """
    return keep_one_of_each(docs, width=3, radius=2)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; the columns stay."""
    return pseudonymise_column(docs)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return pack_documents(docs, WORDS)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII pseudonyms", personal_data),
    ("best-fit packing", packing),
]

# Fingerprints, permutations and tokens have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
