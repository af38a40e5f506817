from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthbook.functions import rules as R
from hearthbook.operators import calendar, listings, spending, summary
from tests.helpers import bill, bills, confirmed, day, households, ids, slot, slots, suggested

NOW = "2026-10-27"
ESTIMATE = suggested(5400, "estimate")


def _summary(spark, slot_rows=(), bill_rows=(), **options):
    frame = summary.household_summary(
        households(spark, 1), slots(spark, slot_rows), bills(spark, bill_rows), NOW, **options
    )
    return frame.collect()[0]


def test_counts_confirmed_bills_due_soon_and_nothing_else(spark):
    rows = [
        bill("soon", confirmed(9250), "2026-10-28"),
        bill("later", confirmed(14500), "2027-01-01"),
        bill("paid", confirmed(3200), "2026-10-29", status="paid"),
    ]
    row = _summary(spark, bill_rows=rows)
    assert (row.still_to_pay_minor, row.still_to_pay_count, row.excluded_from_totals) == (9250, 1, 0)
    assert ids(listings.upcoming(bills(spark, rows)), "bill_id") == ["soon", "later"]


def test_estimates_never_count(spark):
    for estimate in (ESTIMATE, confirmed(5400, "estimate")):
        row = _summary(spark, bill_rows=[bill("e", estimate, "2026-10-30")])
        assert (row.still_to_pay_minor, row.excluded_from_totals, row.needs_details_count) == (0, 0, 0)
        assert row.estimate_count == 1


def test_undated_bill_is_excluded_and_reported(spark):
    row = _summary(spark, bill_rows=[bill("w", confirmed(9000))])
    assert (row.still_to_pay_minor, row.excluded_from_totals, row.missing_date_count) == (0, 1, 1)


def test_overdue_counts_even_unconfirmed_unless_asked_otherwise(spark):
    row = _summary(spark, bill_rows=[bill("late", confirmed(5000), "2026-10-20")])
    assert (row.overdue_count, row.still_to_pay_minor) == (1, 5000)
    unsure = [bill("late", suggested(700), "2026-10-20")]
    assert _summary(spark, bill_rows=unsure).still_to_pay_minor == 700
    strict = _summary(spark, bill_rows=unsure, require_confirmed_overdue=True)
    assert (strict.still_to_pay_minor, strict.excluded_from_totals, strict.overdue_count) == (0, 1, 1)


def test_recurring_uses_confirmed_amounts_only(spark):
    rows = [
        slot("electricity", confirmed("Octopus Energy"), confirmed(9250), "2026-10-28"),
        slot("water", suggested("Wessex Water", "postcodeLookup"), suggested(9000)),
        slot("councilTax", confirmed("Bristol City Council"), confirmed(36000), "2026-11-01",
             frequency="quarterly"),
        slot("gas"),
    ]
    row = _summary(spark, slot_rows=rows)
    assert (row.monthly_recurring_minor, row.monthly_recurring_count) == (21250, 2)
    assert row.unresolved_provider_count == 2
    # A confirmed amount counts while the provider is unconfirmed, not while it is unknown.
    half = [slot("gas", suggested("X"), confirmed(100)), slot("water", amount=confirmed(100))]
    assert _summary(spark, slot_rows=half).monthly_recurring_minor == 100


def test_empty_household_has_zero_row(spark):
    row = _summary(spark)
    assert not row.has_reliable_totals and row.attention_count == 0


def test_summary_is_one_shuffle_without_joins(spark):
    frame = summary.household_summary(households(spark, 1), slots(spark, []), bills(spark, []), NOW)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_bill_states(spark):
    rows = {
        "undated": (bill("undated", confirmed(1)), "needsDetails"),
        "late": (bill("late", confirmed(1), "2026-10-20"), "overdue"),
        "soon": (bill("soon", confirmed(1), "2026-10-30"), "dueSoon"),
        "next": (bill("next", confirmed(1), "2026-12-01"), "upcoming"),
        "paid": (bill("paid", confirmed(1), "2026-10-20", status="paid"), "paid"),
        "today": (bill("today", confirmed(1), NOW), "dueSoon"),
        "week": (bill("week", confirmed(1), "2026-11-03"), "dueSoon"),
        "eight": (bill("eight", confirmed(1), "2026-11-04"), "upcoming"),
    }
    frame = bills(spark, [row for row, _ in rows.values()])
    found = dict(frame.select("bill_id", R.bill_state(NOW)).collect())
    assert found == {name: state for name, (_, state) in rows.items()}


def test_buckets_partition_the_bills_and_totals_equal_their_parts(spark):
    amounts = [(None, "none", "missing", None, None), suggested(10), confirmed(20), ESTIMATE]
    dues = [None, "2026-10-01", "2026-10-28", "2026-11-26", "2026-11-27"]
    rows = [
        bill(f"b{i}{j}{s}", a, d, status=s)
        for i, a in enumerate(amounts) for j, d in enumerate(dues) for s in ("unknown", "paid")
    ]
    frame = bills(spark, rows).select("*", R.summary_bucket(NOW).alias("bucket"))
    row = _summary(spark, bill_rows=rows)
    counts = {r.bucket: r["count"] for r in frame.groupBy("bucket").count().collect()}
    assert sum(counts.values()) == len(rows) and None not in counts
    listed = frame.where("bucket IN ('overdue', 'due')").agg(F.sum("amount_minor.value")).first()[0]
    assert row.still_to_pay_minor == listed
    unpaid = sum(n for b, n in counts.items() if b != "paid")
    assert unpaid == row.upcoming_count + row.needs_details_count + row.estimate_count


def test_bad_as_of_is_an_error():
    with pytest.raises(ValueError):
        R.day("tomorrow")


def test_monthly_spend(spark):
    rows = [
        bill("a", confirmed(1000), "2026-10-05"),
        bill("b", confirmed(2000), "2026-10-25", status="paid"),
        bill("c", confirmed(3000), "2026-09-25"),
        bill("d", suggested(4000, "estimate"), "2026-10-26"),
        bill("e", confirmed(50), period_start="2025-01-31"),
        bill("f", confirmed(60)),
    ]
    spend = spending.monthly_spend(bills(spark, rows)).orderBy(F.desc("month")).collect()
    assert [(r.month, r.total_minor, r.bill_count) for r in spend] == [
        (dt.date(2026, 10, 1), 3000, 2), (dt.date(2026, 9, 1), 3000, 1), (dt.date(2025, 1, 1), 50, 1)]
    newest = spending.monthly_spend(bills(spark, rows), months=1).collect()
    assert [r.total_minor for r in newest] == [3000]


def test_spend_by_kind_rank_and_share(spark):
    rows = [bill("a", confirmed(200), kind="gas"), bill("b", confirmed(100), kind="water"),
            bill("c", confirmed(100), kind="electricity")]
    ranked = spending.spend_by_kind(bills(spark, rows)).orderBy("rank").collect()
    assert [(r.kind, r.share_percent) for r in ranked] == [("gas", 50), ("electricity", 25), ("water", 25)]


def test_lists_are_sorted(spark):
    rows = [
        bill("z", confirmed(1), "2026-12-01"), bill("a", confirmed(1), "2026-12-01"),
        bill("m", confirmed(1), "2026-11-01"), bill("n", confirmed(1), kind="water"),
        bill("o", confirmed(1), kind="gas"), bill("p", ESTIMATE), bill("q", ESTIMATE, "2026-11-05"),
    ]
    frame = bills(spark, rows)
    assert ids(listings.bills_by_date(frame), "bill_id") == ["m", "q", "a", "z", "n", "o", "p"]
    assert ids(listings.upcoming(frame), "bill_id") == ["m", "a", "z"]
    assert ids(listings.needs_details(frame), "bill_id") == ["o", "n"]
    assert ids(listings.estimates(frame), "bill_id") == ["q", "p"]
    top = listings.upcoming_top(frame, 2).orderBy("position")
    assert ids(top, "bill_id") == ["m", "a"]


def test_top_lists_are_cut_before_the_shuffle(spark):
    plan = listings.upcoming_top(bills(spark, []), 5)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_calendar_grid(spark):
    rows = [bill("a", confirmed(5), "2026-02-01"), bill("b", suggested(7), "2026-02-03")]
    grid = calendar.calendar_grid(households(spark, 1), bills(spark, rows), "2026-02-10").orderBy("day").collect()
    assert len(grid) == 28 and grid[0].grid_cell == 6  # 1 February 2026 is a Sunday
    assert [r.marker for r in grid[:3]] == ["confirmed", "none", "other"]
    totals = calendar.calendar_totals(bills(spark, rows), "2026-02-10").first()
    assert (totals.confirmed_minor, totals.unconfirmed_count) == (5, 1)
    december = calendar.calendar_grid(households(spark, 1), bills(spark, []), "2026-12-31").count()
    assert december == 31


def test_setup_order(spark):
    rows = [slot(k) for k in ("other", "wastewater", "broadband", "councilTax", "gas")]
    ordered = ids(listings.setup_order(slots(spark, rows)), "kind")
    assert ordered == ["gas", "councilTax", "broadband", "wastewater", "other"]


def test_days_are_compared_as_dates():
    assert R.day(day("2026-10-27")) == R.day("2026-10-27") == "DATE '2026-10-27'"
