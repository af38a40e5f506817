"""Household summary: what is recurring, still to pay, and what needs attention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import fields as P, rules as R

MEASURES = (
    "monthly_recurring_minor",
    "monthly_recurring_count",
    "still_to_pay_minor",
    "still_to_pay_count",
    "excluded_from_totals",
    "unresolved_provider_count",
    "missing_date_count",
    "overdue_count",
    "upcoming_count",
    "needs_details_count",
    "estimate_count",
)


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def slot_measures(slots: DataFrame) -> DataFrame:
    measured = slots.select(
        S.KEY,
        R.recurring_monthly().alias("monthly_recurring_minor"),
        _one(R.is_unresolved()).alias("unresolved_provider_count"),
    )
    return measured.withColumn("monthly_recurring_count", _one(F.col("monthly_recurring_minor") > 0))


def bill_measures(bills: DataFrame, as_of: R.Day, horizon_days: int,
                  require_confirmed_overdue: bool) -> DataFrame:
    bucketed = bills.where(~R.is_paid()).select(
        S.KEY,
        R.summary_bucket(as_of, horizon_days).alias("bucket"),
        F.expr("amount_minor.value").alias("amount"),
        F.expr(R.SURE).alias("sure"),
    )
    late = "bucket = 'overdue' AND sure" if require_confirmed_overdue else "bucket = 'overdue'"
    counted = f"(bucket = 'due' OR ({late}))"
    left_out = (
        "(bucket IN ('undated', 'unpriced', 'due_unconfirmed') "
        f"OR (bucket = 'overdue' AND NOT ({late})))"
    )
    flags = {
        "still_to_pay_count": counted,
        "excluded_from_totals": left_out,
        "missing_date_count": "bucket = 'undated'",
        "overdue_count": "bucket = 'overdue'",
        "upcoming_count": "bucket IN ('overdue', 'due', 'due_unconfirmed', 'later')",
        "needs_details_count": "bucket IN ('undated', 'unpriced')",
        "estimate_count": "bucket = 'estimate'",
    }
    return bucketed.selectExpr(
        S.KEY,
        f"if({counted}, amount, 0L) AS still_to_pay_minor",
        *[f"if({condition}, 1L, 0L) AS {name}" for name, condition in flags.items()],
    )


def household_summary(households: DataFrame, slots: DataFrame, bills: DataFrame,
                      as_of: R.Day, horizon_days: int = S.STILL_TO_PAY_DAYS,
                      require_confirmed_overdue: bool = False) -> DataFrame:
    """One row per household, zeros where nothing is recorded.

    The three tables are stacked and summed in one aggregation, so there is one
    shuffle, of rows already summed per household on the map side: a household
    with very many bills costs each task one row.

    Overdue bills count without a confirmed amount unless
    ``require_confirmed_overdue`` is set.
    """
    known = households.select(S.KEY, F.lit(1).alias("known"))
    stacked = _union(
        [
            known,
            slot_measures(slots),
            bill_measures(bills, as_of, horizon_days, require_confirmed_overdue),
        ]
    )
    sums = [F.expr(f"coalesce(sum({name}), 0L) AS {name}") for name in MEASURES]
    summed = stacked.groupBy(S.KEY).agg(F.max("known").alias("known"), *sums)
    return summed.where("known = 1").select(
        S.KEY,
        *MEASURES,
        F.expr("monthly_recurring_count > 0 OR still_to_pay_count > 0").alias("has_reliable_totals"),
        F.expr("excluded_from_totals + unresolved_provider_count + overdue_count").alias(
            "attention_count"
        ),
    )


def services_outstanding(households: DataFrame, slots: DataFrame) -> DataFrame:
    """Per household: services, those not ready, and whether no provider is known at all."""
    measured = slots.select(
        S.KEY,
        F.lit(1).cast("bigint").alias("service_count"),
        _one(~R.is_ready()).alias("outstanding_count"),
        _one(P.has_value(F.col("provider"))).alias("with_provider"),
    )
    stacked = _union([households.select(S.KEY, F.lit(1).alias("known")), measured])
    totals = stacked.groupBy(S.KEY).agg(
        F.max("known").alias("known"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("service_count", "outstanding_count", "with_provider")
        ],
    )
    return totals.where("known = 1").select(
        S.KEY,
        "service_count",
        "outstanding_count",
        (F.col("with_provider") == 0).alias("nothing_discovered"),
    )


def household_counts(households: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """Member and document counts per household, in one aggregation."""
    one = F.lit(1).cast("bigint")
    stacked = _union(
        [
            households.select(S.KEY, F.lit(1).alias("known")),
            members.select(S.KEY, one.alias("member_count")),
            documents.select(S.KEY, one.alias("document_count")),
        ]
    )
    totals = stacked.groupBy(S.KEY).agg(
        F.max("known").alias("known"),
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("member_count", "document_count")
        ],
    )
    return totals.where("known = 1").drop("known")


def household_stages(households: DataFrame, properties: DataFrame) -> DataFrame:
    """setup (no property yet), confirm (not onboarded) or active."""
    stacked = _union(
        [
            households.select(S.KEY, "onboarding_complete", F.lit(1).alias("known")),
            properties.select(S.KEY, F.lit(1).alias("placed")),
        ]
    )
    merged = stacked.groupBy(S.KEY).agg(
        F.max("known").alias("known"),
        F.max("placed").alias("placed"),
        F.max("onboarding_complete").alias("onboarding_complete"),
    )
    return merged.where("known = 1").select(
        S.KEY, R.household_stage("placed IS NOT NULL").alias("stage")
    )
