"""Calendar month: day markers, month totals, the day grid, what is due next."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import rules as R


def _month_bounds(month: str) -> tuple[dt.date, dt.date]:
    first = dt.date.fromisoformat(month).replace(day=1)
    return first, (first + dt.timedelta(days=31)).replace(day=1)


def bills_of_month(bills: DataFrame, month: str) -> DataFrame:
    """Bills due in a month. A plain range on the date, so Parquet can skip on it."""
    first, after = _month_bounds(month)
    due = F.col("due_date")["value"]
    return bills.where((due >= F.lit(first)) & (due < F.lit(after)))


def day_bills(bills: DataFrame, month: str) -> DataFrame:
    """The bills behind each calendar day, as sorted rows rather than nested lists."""
    return bills_of_month(bills, month).orderBy(S.KEY, F.col("due_date")["value"], "bill_id")


def _day_measures(bills: DataFrame, month: str) -> DataFrame:
    sure = R.has_confirmed_amount()
    return bills_of_month(bills, month).select(
        S.KEY,
        F.col("due_date")["value"].alias("day"),
        F.lit(1).cast("bigint").alias("bill_count"),
        sure.alias("has_confirmed"),
        F.when(~R.is_paid() & sure, F.col("amount_minor")["value"]).otherwise(0).alias("confirmed_minor"),
        F.when(~R.is_paid() & ~sure, 1).otherwise(0).cast("bigint").alias("unconfirmed_count"),
    )


def _sum_days(days: DataFrame, *keys: str) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.coalesce(F.sum("bill_count"), F.lit(0)).alias("bill_count"),
        F.coalesce(F.sum("confirmed_minor"), F.lit(0)).alias("confirmed_minor"),
        F.coalesce(F.sum("unconfirmed_count"), F.lit(0)).alias("unconfirmed_count"),
        F.coalesce(F.bool_or("has_confirmed"), F.lit(False)).alias("has_confirmed"),
    )


def _marker() -> Column:
    return (
        F.when(F.col("has_confirmed"), "confirmed")
        .when(F.col("bill_count") > 0, "other")
        .otherwise("none")
    )


def calendar_days(bills: DataFrame, month: str) -> DataFrame:
    """Per household and day with bills: counts, amounts of unpaid bills, marker."""
    summed = _sum_days(_day_measures(bills, month), S.KEY, "day")
    return summed.withColumn("marker", _marker()).drop("has_confirmed")


def calendar_totals(bills: DataFrame, month: str) -> DataFrame:
    """Per household: the month's confirmed total and unconfirmed count, unpaid bills only."""
    return _sum_days(_day_measures(bills, month), S.KEY).drop("has_confirmed")


def calendar_grid(households: DataFrame, bills: DataFrame, month: str) -> DataFrame:
    """Every day of the month for every household, with the Monday-first grid cell.

    Bills are summed per day first, then a household's days, 31 at most, are gathered next to it, and
    its empty days are laid out last: no shuffle or aggregation holds a row for each of them.
    """
    first, after = _month_bounds(month)
    last = after - dt.timedelta(days=1)
    summed = _sum_days(_day_measures(bills, month), S.KEY, "day").select(
        S.KEY, F.struct("day", "bill_count", "has_confirmed").alias("with_bills")
    )
    known = households.select(S.KEY, F.lit(1).alias("known"))
    stacked = known.unionByName(summed, allowMissingColumns=True)
    gathered = stacked.groupBy(S.KEY).agg(F.max("known").alias("known"), F.collect_list("with_bills").alias("days"))
    found = F.filter("days", lambda of: of["day"] == F.col("day"))
    grid = gathered.where("known = 1").select(
        S.KEY, "days", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    ).select(S.KEY, "day", F.get(found, F.lit(0)).alias("found"))
    blanks = F.weekday(F.lit(first))
    return grid.select(
        S.KEY,
        "day",
        (blanks + F.dayofmonth("day") - 1).cast("bigint").alias("grid_cell"),
        F.coalesce(F.col("found")["bill_count"], F.lit(0)).alias("bill_count"),
        F.coalesce(F.col("found")["has_confirmed"], F.lit(False)).alias("has_confirmed"),
    ).select(S.KEY, "day", "grid_cell", "bill_count", _marker().alias("marker"))


def due_next(bills: DataFrame, as_of: R.Day, days: int = S.DUE_SOON_DAYS) -> DataFrame:
    """Unpaid bills due within ``days``, estimates included, by date."""
    near = bills.where(R.is_due_within(as_of, days))
    return near.orderBy(S.KEY, F.col("due_date")["value"], "bill_id")
