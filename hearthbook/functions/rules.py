"""Classification rules for bills, services, reminders and households.

The rules are SQL conditions over the ledger's own column names: bill rules read
``amount_minor``, ``due_date`` (fields) and ``payment_status``, service rules read
``provider``, ``amount_minor``, ``next_due_date`` and ``frequency``. Each rule ends up
as one expression inside the scan stage. All conditions are null-safe: a missing
field gives false, never null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from hearthbook import schema as S
from hearthbook.functions import scalars as X

Day = str | dt.date


def day(as_of: Day) -> str:
    """A date literal; raises on text that is not an ISO day."""
    return f"DATE '{dt.date.fromisoformat(str(as_of))}'"


def _held(name: str) -> str:
    return f"({name}.value IS NOT NULL AND coalesce({name}.status, 'missing') <> 'missing')"


PAID = "(payment_status <=> 'paid')"
ESTIMATE = "(amount_minor.source <=> 'estimate')"
SURE = "(amount_minor.status <=> 'confirmed' AND amount_minor.value IS NOT NULL)"
CONFIRMED_AMOUNT = f"({SURE} AND NOT {ESTIMATE})"
DATED = _held("due_date")
ACTIONABLE = f"({_held('amount_minor')} AND {DATED})"

NO_PROVIDER = "(provider.value IS NULL)"
UNCONFIRMED_PROVIDER = "(provider.status <=> 'suggested' AND provider.value IS NOT NULL)"
READINESS = (
    f"CASE WHEN {NO_PROVIDER} THEN 'notFound' WHEN {UNCONFIRMED_PROVIDER} THEN 'needsConfirmation' "
    "WHEN amount_minor.value IS NULL OR next_due_date.value IS NULL THEN 'needsDetails' ELSE 'ready' END"
)
NOT_DONE = "(NOT coalesce(is_done, false))"


def _overdue(as_of: Day) -> str:
    return f"(NOT {PAID} AND due_date.value IS NOT NULL AND due_date.value < {day(as_of)})"


def _due_within(as_of: Day, days: int) -> str:
    """A plain date range, null-safe by its first term, so that Parquet can skip on it."""
    last = dt.date.fromisoformat(str(as_of)) + dt.timedelta(days=days)
    return (
        f"(NOT {PAID} AND due_date.value IS NOT NULL AND due_date.value >= {day(as_of)} "
        f"AND due_date.value <= {day(last)})"
    )


# ---- bills ----------------------------------------------------------------


def is_paid() -> Column:
    return F.expr(PAID)


def is_estimate() -> Column:
    """The source alone decides, whatever the status says."""
    return F.expr(ESTIMATE)


def has_confirmed_amount() -> Column:
    return F.expr(CONFIRMED_AMOUNT)


def is_actionable() -> Column:
    return F.expr(ACTIONABLE)


def is_overdue(as_of: Day) -> Column:
    return F.expr(_overdue(as_of))


def is_due_within(as_of: Day, days: int) -> Column:
    return F.expr(_due_within(as_of, days))


def _state(as_of: Day, rest: str) -> str:
    return (
        f"CASE WHEN {PAID} THEN 'paid' WHEN NOT {ACTIONABLE} THEN 'needsDetails' "
        f"WHEN {_overdue(as_of)} THEN 'overdue' "
        f"WHEN {_due_within(as_of, S.DUE_SOON_DAYS)} THEN 'dueSoon' ELSE '{rest}' END"
    )


def bill_state(as_of: Day) -> Column:
    return F.expr(_state(as_of, "upcoming"))


def bill_section(as_of: Day) -> Column:
    """Section of the bill list; an unpaid estimate has its own."""
    return F.expr(
        f"CASE WHEN {ESTIMATE} AND NOT {PAID} THEN 'estimate' ELSE {_state(as_of, 'later')} END"
    )


FILTERS = {
    "all": "true",
    "toPay": f"(NOT {PAID} AND {ACTIONABLE} AND NOT {ESTIMATE})",
    "needsDetails": f"(NOT {PAID} AND (NOT {ACTIONABLE} OR {ESTIMATE}))",
    "paid": PAID,
}


def in_filter(name: str) -> Column:
    """Membership in one of the bill list's filters."""
    return F.expr(FILTERS[name])


def display_state(as_of: Day) -> Column:
    """State shown on a tile: an unpaid estimate reads as needing details."""
    return F.expr(
        f"CASE WHEN {ESTIMATE} AND NOT {PAID} THEN 'needsDetails' ELSE {_state(as_of, 'upcoming')} END"
    )


def when_text(as_of: Day) -> Column:
    """What a tile says about time: which part is missing, paid, or how far off."""
    known = F.expr(
        f"CASE WHEN {PAID} THEN 'paid' WHEN NOT {ACTIONABLE} AND {DATED} THEN 'amount_missing' "
        f"WHEN NOT {ACTIONABLE} THEN 'date_missing' END"
    )
    distance = X.relative_due_label(F.expr("due_date.value"), F.expr(day(as_of)))
    text = F.coalesce(known, distance)
    return F.when(is_estimate(), F.concat(F.lit("estimate: "), text)).otherwise(text)


def spend_counts() -> Column:
    """Does the bill count as recorded spend? Paid or not does not matter."""
    return has_confirmed_amount()


def summary_bucket(as_of: Day, horizon_days: int = S.STILL_TO_PAY_DAYS) -> Column:
    """One bucket per bill; the summary counts and sums are per bucket."""
    within = _due_within(as_of, horizon_days)
    return F.expr(
        f"CASE WHEN {PAID} THEN 'paid' WHEN {ESTIMATE} THEN 'estimate' "
        f"WHEN NOT {DATED} THEN 'undated' WHEN NOT {ACTIONABLE} THEN 'unpriced' "
        f"WHEN {_overdue(as_of)} THEN 'overdue' WHEN {within} AND {SURE} THEN 'due' "
        f"WHEN {within} THEN 'due_unconfirmed' ELSE 'later' END"
    )


# ---- services -------------------------------------------------------------


def readiness() -> Column:
    return F.expr(READINESS)


def is_unresolved() -> Column:
    return F.expr(f"({NO_PROVIDER} OR {UNCONFIRMED_PROVIDER})")


def is_ready() -> Column:
    return F.expr(f"({READINESS} = 'ready')")


def next_action() -> Column:
    return F.expr(
        f"CASE {READINESS} WHEN 'notFound' THEN 'find_provider' "
        "WHEN 'needsConfirmation' THEN 'confirm_provider' "
        "WHEN 'needsDetails' THEN if(amount_minor.value IS NULL, 'add_amount', 'add_date') "
        "ELSE 'none' END"
    )


def recurring_monthly() -> Column:
    """Pence per month a service adds to the recurring total, 0 if it adds none."""
    counts = F.expr(f"NOT {NO_PROVIDER} AND {CONFIRMED_AMOUNT}")
    monthly = X.monthly_equivalent(F.expr("amount_minor.value"), F.col("frequency"))
    return F.when(counts, F.greatest(monthly, F.lit(0).cast("bigint"))).otherwise(0).cast("bigint")


# ---- reminders and households ---------------------------------------------


def reminder_open() -> Column:
    return F.expr(NOT_DONE)


def reminder_overdue(as_of: Day) -> Column:
    return F.expr(f"({NOT_DONE} AND due_at < {day(as_of)})")


def household_stage(has_property: str) -> Column:
    """``has_property`` is a SQL condition."""
    return F.expr(
        f"CASE WHEN NOT ({has_property}) THEN 'setup' "
        "WHEN NOT coalesce(onboarding_complete, false) THEN 'confirm' ELSE 'active' END"
    )
