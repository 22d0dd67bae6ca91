"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``; the last returns a row of token ids per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm import bpe, mixing, near_dups, pii, quality_rules
from grantloom.llm.common import read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return quality_rules.apply_policy(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates."""
    return near_dups.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their domain's target weight asks; surely toxic ones get rate 0, all
    others 1 at least."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"), keep=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, with digests of the ids and of the text they decode to."""
    return bpe.round_trip(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixing_weights),
    ("bpe", tokens),
]

#: Signatures, trained classifiers and token merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
