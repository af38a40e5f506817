"""A corpus pipeline over `documents`: quality, near-duplicates, decontamination, PII, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage as
Parquet in the shared folder and reads it again for the next, so that a lost executor never
costs more than a stage. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthbook.llm import byte_bpe, decontamination, near_copies, pii, quality_knn
from hearthbook.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier accepts (score of 0.3 or more)."""
    return quality_knn.of_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies (0.8 or more of five-word shingles)."""
    return near_copies.keep_one(docs, words=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 or more of its five-word shingles."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew."""
    return pii.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every remaining document, with digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs, byte_bpe.default_path(), byte_bpe.default_pattern(), with_ids=True)


STAGES = [
    ("quality_knn", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii_redaction", pii_stage),
    ("byte_bpe_encoding", bpe_stage),
]

#: The classifier, the trees and the encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
