"""Corpus clean-up and packing in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage works on
every row its predecessor kept, and what it decides takes effect: low quality, exact and near copies go, secrets are masked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlake.llm import exact_dedup, neardup, packing, quality, secrets
from actlake.llm.common import cut, documents, fold, labels, tokenizer

#: SQL can express neither the trained classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; it never learns from the held-out fold's labels."""
    model = quality.train(docs, labels(spark, sf_dir), fold("doc_id", 5) != 0)
    return quality.drop_low(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return neardup.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.mask(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces of at most 4096 tokens, each with its sequence and place there."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is checkpointed, as the next one reads it more than once."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
