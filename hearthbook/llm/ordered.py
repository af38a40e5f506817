"""Rows in ascending doc_id order over many partitions, without one task that sees them all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def shuffle_width(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def borders(docs: DataFrame, count: int) -> list[int]:
    """Up to count - 1 ids that cut the rows into parts of about equal size; reads ids only."""
    shares = [i / count for i in range(1, count)]
    found = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double")).approxQuantile("doc_id", shares, 0.25 / count)
    return sorted({int(x) for x in found or []})


def part_of(cuts: list[int], column: str = "doc_id") -> Column:
    """The part a row belongs to: how many cuts are not beyond its id; null ids come first of all, in part -1.

    Looked up in the sorted cuts, a batch of ids at once, so the plan is the same for any number of parts.
    """
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32))

    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(place(F.coalesce(F.col(column), F.lit(0)).cast("long"))).cast("int")
