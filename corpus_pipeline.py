"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; the last one returns a row per packed piece. Between stages the documents are written to the
shared scratch folder and read again, so a lost executor costs no more than the stage it was in.

Null and empty texts fail the quality rules and go in the first stage. Rows without an id, and rows that repeat an id
with another text, are judged by their text in the first two stages, pass the next two untouched (no other document can
name them), and those with an id are packed; rows that repeat both id and text go down to one in the second stage. An
empty table stays empty through all stages, and without labels the quality stage has its base rules only. Other columns
pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chaining, exact_dedup, line_crf, minhash, packing
from tessera.llm.common import documents, written


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line CRF (fitted on all given labels) keep."""
    return line_crf.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z as a-z), the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles, the one with the smallest id."""
    return minhash.drop_near(docs)


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; ``n_chars`` follows the text."""
    return chaining.drop_passages(docs, length_col="n_chars")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", stage_quality),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("substring_dedup", stage_substrings),
    ("best_fit_packing", stage_packing),
]

#: The CRF, chaining and packing are not SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
