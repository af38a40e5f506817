"""Recorded spend per month and per service kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hearthbook import schema as S
from hearthbook.functions import rules as R, scalars as X


def _spend(bills: DataFrame) -> DataFrame:
    anchor = F.coalesce(F.col("due_date")["value"], F.col("period_start"))
    return bills.where(R.spend_counts()).select(
        S.KEY,
        "kind",
        X.month_start(anchor).alias("month"),
        F.col("amount_minor")["value"].alias("amount"),
    )


def monthly_spend(bills: DataFrame, months: int = 6) -> DataFrame:
    """Confirmed spend per household and month, for its newest ``months`` with data.

    A bill counts in the month of its due date, else of its period start. The
    ranking runs over month totals, a few dozen rows per household at most.
    """
    totals = (
        _spend(bills)
        .where(F.col("month").isNotNull())
        .groupBy(S.KEY, "month")
        .agg(F.sum("amount").alias("total_minor"), F.count("*").alias("bill_count"))
    )
    newest = Window.partitionBy(S.KEY).orderBy(F.desc("month"))
    return totals.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= months).drop("rank")


def month_bars(bills: DataFrame, months: int = 12) -> DataFrame:
    """Month totals with each bar's share of the largest listed month."""
    listed = monthly_spend(bills, months)
    largest = F.max("total_minor").over(Window.partitionBy(S.KEY))
    ratio = F.when(largest <= 0, F.lit(0.0)).otherwise(F.col("total_minor") / largest)
    return listed.withColumn("bar_ratio", ratio)


def spending_totals(bills: DataFrame, months: int = 12) -> DataFrame:
    """Total and largest month over the listed months; the largest is never below 0."""
    return (
        monthly_spend(bills, months)
        .groupBy(S.KEY)
        .agg(
            F.sum("total_minor").alias("total_minor"),
            F.greatest(F.max("total_minor"), F.lit(0)).alias("largest_minor"),
            F.count("*").alias("month_count"),
        )
    )


def spend_by_kind(bills: DataFrame) -> DataFrame:
    """Spend per service kind (no date needed), ranked, with whole-percent share."""
    totals = _spend(bills).groupBy(S.KEY, "kind").agg(F.sum("amount").alias("total_minor"))
    household = Window.partitionBy(S.KEY)
    all_kinds = F.sum("total_minor").over(household)
    share = F.when(all_kinds == 0, F.lit(0)).otherwise(
        F.round(F.col("total_minor") * 100 / all_kinds, 0)
    )
    ranked = household.orderBy(F.desc("total_minor"), X.kind_ordinal(F.col("kind")))
    return totals.select(
        S.KEY,
        "kind",
        "total_minor",
        share.cast("bigint").alias("share_percent"),
        F.row_number().over(ranked).cast("bigint").alias("rank"),
    )
