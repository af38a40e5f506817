"""Documents with labels, and which of them a model may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import fold_of, text_of

HELD_OUT_FOLDS = 5


def training_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the ids outside fold 0: one row per id, the largest label where several are given.

    Rows with a null id or label teach nothing.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & (fold_of(HELD_OUT_FOLDS) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(name).cast("int")).alias("label"))
    )


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, label); an id with several texts counts once, with the least of them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
