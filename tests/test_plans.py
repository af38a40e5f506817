"""What reaches the scan when the ledger is stored as Parquet."""

from __future__ import annotations

import re

import pytest

from hearthbook.operators import calendar, listings, spending, summary
from tests.helpers import bill, bills, confirmed, households, slot, slots


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger"))
    bills(spark, [bill("a", confirmed(1), "2026-10-01")]).write.parquet(f"{path}/bills")
    slots(spark, [slot("gas")]).write.parquet(f"{path}/slots")
    return spark.read.parquet(f"{path}/bills"), spark.read.parquet(f"{path}/slots")


def _scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PushedFilters: .*", plan)


def test_date_ranges_and_status_reach_the_scan(stored):
    table, _ = stored
    (month,) = _scans(calendar.calendar_days(table, "2026-10-01"))
    assert "GreaterThanOrEqual(due_date.value,2026-10-01)" in month
    (near,) = _scans(calendar.due_next(table, "2026-10-01"))
    assert "Not(EqualNullSafe(payment_status,paid))" in near and "GreaterThanOrEqual(due_date" in near
    (spend,) = _scans(spending.monthly_spend(table))
    assert "EqualNullSafe(amount_minor.status,confirmed)" in spend
    (top,) = _scans(listings.upcoming_top(table))
    assert "IsNotNull(amount_minor.value)" in top


def test_only_needed_members_are_read(spark, stored):
    table, slot_table = stored
    scans = _scans(summary.household_summary(households(spark, 1), slot_table, table, "2026-10-27"))
    assert len(scans) == 2
    for scan in scans:
        assert "recorded_at" not in scan and "note" not in scan and "lookup_keys" not in scan
