"""One household with a third of all rows: results stay whole, work stays spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hearthbook import schema as S
from hearthbook.functions import fields as P
from hearthbook.operators import commands as C, listings, spending, summary
from hearthbook.sources import documents as D
from tests.helpers import slots

ROWS = 90_000
AS_OF = "2026-10-27"


@pytest.fixture(scope="module")
def ledger(spark):
    """Bills of 1,001 households; household 0 holds a third of them."""
    key = F.col("id")
    bills = spark.range(ROWS).select(
        F.concat(F.lit("b"), key.cast("string")).alias("bill_id"),
        F.when(key % 3 == 0, 0).otherwise(key % 1000 + 1).cast("bigint").alias("household_id"),
        F.lit("gas").alias("kind"),
        P.confirmed(F.lit("X")).alias("provider"),
        P.confirmed((key % 7 + 1), "userEntered").alias("amount_minor"),
        P.confirmed(F.date_add(F.lit("2026-10-01").cast("date"), (key % 50).cast("int"))).alias("due_date"),
        F.lit(None).cast("date").alias("period_start"),
        F.lit(None).cast("date").alias("period_end"),
        F.lit("monthly").alias("frequency"),
        F.lit("unknown").alias("payment_status"),
        F.lit(None).cast("string").alias("document_id"),
        F.lit(None).cast("string").alias("notes"),
        F.lit("2026-01-01").cast("timestamp").alias("created_at"),
        F.lit("2026-01-01").cast("timestamp").alias("updated_at"),
    )
    households = spark.range(1001).select(
        F.col("id").alias("household_id"), F.lit("H").alias("name"), F.lit(None).cast("string").alias("property_id"),
        F.lit(None).cast("string").alias("current_member_id"), F.lit(True).alias("onboarding_complete"),
    )
    return households, bills.cache()


def test_totals_of_the_large_household(spark, ledger):
    households, bills = ledger
    row = summary.household_summary(households, slots(spark, []), bills, AS_OF).where("household_id = 0").first()
    # All its due days lie before the horizon ends, so every bill is either overdue or due.
    assert row.still_to_pay_count == ROWS // 3
    assert row.still_to_pay_minor == sum(i % 7 + 1 for i in range(0, ROWS, 3))
    spend = spending.monthly_spend(bills).where("household_id = 0").agg(F.sum("bill_count")).first()[0]
    assert spend == ROWS // 3


def test_sorted_list_spreads_the_large_household(spark, ledger):
    _, bills = ledger
    # Small partitions are usually merged, which would hide how the sort splits the rows;
    # and a grouping on top would drop the sort, so the rows themselves are collected.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = listings.bills_by_date(bills).select(
            "household_id", "bill_id", F.col("due_date.value").alias("due"), F.spark_partition_id().alias("task")
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    mine = [r for r in listed if r.household_id == 0]
    assert len(mine) == ROWS // 3 and len({r.task for r in mine}) > 1
    assert [(r.household_id, r.due, r.bill_id) for r in listed] == sorted(
        (r.household_id, r.due, r.bill_id) for r in listed
    )


def test_top_list_of_the_large_household(spark, ledger):
    _, bills = ledger
    top = listings.upcoming_top(bills, 5).where("household_id = 0").orderBy("position").collect()
    first_day = sorted(f"b{i}" for i in range(0, ROWS, 3) if i % 50 == 0)
    assert [r.bill_id for r in top] == first_day[:5]


def test_documents_of_the_large_household_are_bounded(spark, ledger):
    households, bills = ledger
    empty = {name: spark.createDataFrame([], ddl) for name, ddl in {
        "properties": S.PROPERTIES, "service_slots": S.SERVICE_SLOTS, "documents": S.DOCUMENTS,
        "reminders": S.REMINDERS, "members": S.MEMBERS}.items()}
    tables = {"households": households, "bills": bills, **empty}
    written = D.household_documents(tables)
    longest = written.where("household_id = 0").agg(F.count("*"), F.max(F.length("json"))).first()
    assert longest[0] == ROWS // 3 + 1 and longest[1] < 1000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = D.in_order(written).select("household_id", F.spark_partition_id().alias("task"), "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.task for r in rows if r.household_id == 0}) > 1
    pieces = D.document_pieces(tables).where("household_id = 0").agg(F.count("*"), F.max(F.length("piece"))).first()
    assert pieces[0] == ROWS // 3 + 6 and pieces[1] < 1000


def test_slots_follow_the_large_household(spark, ledger):
    _, bills = ledger
    one = slots(spark, [("svc-0", 0, "gas", None, None, None, None, "weekly", [], None)])
    row = C.sync_slots(one, bills).first()
    newest = max(f"b{i}" for i in range(0, ROWS, 3))
    assert row.amount_minor.value == int(newest[1:]) % 7 + 1
