"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthbook.llm import (
    byte_bpe, decontamination, edit_embedding, jaccard_groups, katz, merkle_fixity, pii, prefix_trie, quality_knn, simhash, simple8b, toxicity_mil, whitening,
)
from hearthbook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_fixity.fixity_audit(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe.default_path(), byte_bpe.default_pattern())


def op3_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.with_neighbours(table(spark, sf_dir, "documents"))


def op4_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_mil.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.listed(table(spark, sf_dir, "documents"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.stored_ids(table(spark, sf_dir, "documents"), simple8b.default_tokenizer())


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("enter", "leave")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.jaccard_join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_merkle_fixity, op2_byte_bpe, op3_edit_embedding, op4_toxicity_mil, op5_quality_knn,
        op6_decontamination, op7_katz, op8_pii, op9_simple8b, op10_simhash,
        op11_prefix_trie, op12_whitening, op13_jaccard_groups,
    )
}
