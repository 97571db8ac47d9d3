"""The corpus pipeline: classify, deduplicate exactly, deduplicate near copies, redact personal data, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import exact, near, packing, pii, quality
from palimpsest.llm.shared import documents, materialise


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring at least the threshold; the classifier is fitted on a bounded sample of labelled documents."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then the one of smallest id."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard of at least 0.8 over five-word shingles, the document of smallest id."""
    return near.deduplicate(docs, words=5, threshold=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars counts the new text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.digest_query(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack_tokens),
]

#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
