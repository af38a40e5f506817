"""Sorted lists of bills, reminders and services.

Whole lists are sorted by ``orderBy(household, ..., id)``: the id is part of the
range key, so one household with very many rows spreads over many tasks. Only
top-k lists use a window, whose limit Spark applies before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook import schema as S
from hearthbook.functions import fields as P, rules as R, scalars as X


def _due() -> Column:
    return F.col("due_date")["value"]


def bills_by_date(bills: DataFrame) -> DataFrame:
    return bills.orderBy(S.KEY, _due().asc_nulls_last(), "bill_id")


def filtered_bills(bills: DataFrame, name: str = "all") -> DataFrame:
    return bills_by_date(bills.where(R.in_filter(name)))


def upcoming(bills: DataFrame) -> DataFrame:
    """Unpaid bills with amount and date, estimates left out, by date."""
    return filtered_bills(bills, "toPay")


def upcoming_top(bills: DataFrame, count: int = 5) -> DataFrame:
    """The first ``count`` upcoming bills of each household, with their position."""
    soonest = Window.partitionBy(S.KEY).orderBy(_due().asc_nulls_last(), "bill_id")
    ranked = bills.where(R.in_filter("toPay")).withColumn("position", F.row_number().over(soonest))
    return ranked.where(F.col("position") <= count)


def needs_details(bills: DataFrame) -> DataFrame:
    """Unpaid bills that lack amount or date (estimates apart), by service kind."""
    lacking = bills.where(~R.is_paid() & ~R.is_estimate() & ~R.is_actionable())
    return lacking.orderBy(S.KEY, X.kind_ordinal(F.col("kind")), "bill_id")


def estimates(bills: DataFrame) -> DataFrame:
    return bills_by_date(bills.where(~R.is_paid() & R.is_estimate()))


def section_counts(bills: DataFrame, as_of: R.Day) -> DataFrame:
    """Bills per household and section; a section without bills has no row."""
    return (
        bills.select(S.KEY, R.bill_section(as_of).alias("section"))
        .groupBy(S.KEY, "section")
        .agg(F.count("*").alias("bill_count"))
    )


def bill_tiles(bills: DataFrame, as_of: R.Day) -> DataFrame:
    """What a bill tile shows, as codes and formatted text."""
    return bills.select(
        "bill_id",
        S.KEY,
        R.display_state(as_of).alias("display_state"),
        R.when_text(as_of).alias("when_text"),
        F.coalesce(F.col("provider")["value"], F.lit("not_recorded")).alias("provider_text"),
        X.format_money(F.col("amount_minor")["value"]).alias("amount_text"),
        F.when(P.has_value(F.col("due_date")), X.format_date(_due(), "short")).alias("date_text"),
    )


def open_reminders(reminders: DataFrame, as_of: R.Day) -> DataFrame:
    """Reminders not done, by date, with an overdue flag."""
    flagged = reminders.where(R.reminder_open()).withColumn("overdue", R.reminder_overdue(as_of))
    return flagged.orderBy(S.KEY, "due_at", "reminder_id")


def done_reminders(reminders: DataFrame) -> DataFrame:
    return reminders.where(~R.reminder_open())


def setup_order(slots: DataFrame) -> DataFrame:
    """Services in setup order: five ranked kinds first, the rest in kind order."""
    kind = F.col("kind")
    return slots.withColumn("setup_rank", X.setup_rank(kind)).orderBy(
        S.KEY, "setup_rank", X.kind_ordinal(kind)
    )


def slot_actions(slots: DataFrame) -> DataFrame:
    """Readiness and next action of every service."""
    return slots.select(
        "slot_id",
        S.KEY,
        "kind",
        R.readiness().alias("readiness"),
        R.next_action().alias("next_action"),
    )
