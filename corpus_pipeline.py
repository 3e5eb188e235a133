"""From raw documents to packed training sequences: five stages, each a table the next one reads.

Toxic documents go, then documents that the quality rules reject; one document of each near-duplicate
class stays; secrets are masked in the texts of the rest; what remains is tokenized and packed.
Every stage but the last returns the columns of `documents`, and works on all rows it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tocsin.llm import near_dup, packing, quality, secret_scan, toxicity
from tocsin.llm.shared import read_table, store


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold, by a model of the table `labels`."""
    return toxicity.clean(docs, read_table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passed(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id."""
    return near_dup.distinct_documents(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the new text."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_quality),
    ("near-dedup", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store(docs, f"stage-{number}")
    return docs


# A learned score, sampled signatures and a tokenizer aren't SQL; tests/llm/test_pipeline.py restates the stages.
ORACLE_SQL = None
