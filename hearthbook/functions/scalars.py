"""Scalar functions: money, frequencies, dates, postcodes, addresses, roles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce

# Display formats.
MASK = "••••"
DASH = "—"
DATE_FORMATS = {
    "long": "d MMMM yyyy",
    "short": "d MMM",
    "month_year": "MMMM yyyy",
    "compact": "d MMM yyyy",
    "iso": "yyyy-MM-dd",
    "month": "MMMM",
    "weekday": "EEE",
}
DUE_TODAY, DUE_TOMORROW, ONE_DAY_LATE = "Due today", "Due tomorrow", "1 day late"
DAYS_LATE, DUE_IN_DAYS, DUE_ON = "%s days late", "Due in %s days", "Due %s"
POSTCODE_FORMAT = r"(?i)^[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}$"


# ---- money ----------------------------------------------------------------


def parse_money(text: Column) -> Column:
    """Typed money to pence: '£1,234.5' -> 123450. Empty or unreadable is null."""
    cleaned = coerce.trim(F.translate(text, "£, ", ""))
    pounds = coerce.to_double(cleaned)
    return F.round(pounds * 100, 0).try_cast("bigint")


def format_money(minor: Column, with_pence: bool = True, symbol: str = "£") -> Column:
    """Pence to text: sign, symbol, grouped thousands; null is a dash."""
    size = F.abs(minor)
    pence = size % 100
    pounds = F.format_number(F.call_function("div", size, F.lit(100)), 0)
    parts = [F.when(minor < 0, "-").otherwise(""), F.lit(symbol), pounds]
    if with_pence:
        parts += [F.lit("."), F.lpad(pence.cast("string"), 2, "0")]
    return F.when(minor.isNull(), DASH).otherwise(F.concat(*parts))


def per_year(frequency: Column) -> Column:
    """Payments per year; unknown names count as monthly."""
    known = F.try_element_at(coerce.lookup(S.FREQUENCIES_PER_YEAR), frequency)
    return F.coalesce(known, F.lit(S.FREQUENCIES_PER_YEAR["monthly"]))


def monthly_equivalent(minor: Column, frequency: Column) -> Column:
    """Pence per month, rounded half away from zero; null counts as 0."""
    doubled = F.abs(minor) * per_year(frequency) * 2
    rounded = F.call_function("div", doubled + 12, F.lit(24))
    return F.coalesce(F.when(minor < 0, -rounded).otherwise(rounded), F.lit(0)).cast("bigint")


# ---- dates ----------------------------------------------------------------


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def format_date(day: Column, style: str) -> Column:
    return F.date_format(day, DATE_FORMATS[style])


def relative_due_label(due: Column, as_of: Column) -> Column:
    days = days_between(as_of, due)
    return (
        F.when(days == 0, DUE_TODAY)
        .when(days == 1, DUE_TOMORROW)
        .when(days == -1, ONE_DAY_LATE)
        .when(days < 0, F.format_string(DAYS_LATE, (-days).cast("string")))
        .when(days < 7, F.format_string(DUE_IN_DAYS, days.cast("string")))
        .when(days >= 7, F.format_string(DUE_ON, format_date(due, "short")))
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


# ---- postcodes ------------------------------------------------------------


def normalise_postcode(text: Column) -> Column:
    """Upper case, one blank before the last three characters of five or more.

    Each step is used once: filters repeat what they are made of at every use.
    """
    compact = F.upper(F.regexp_replace(text, f"[{coerce.SPACE}]+", ""))
    return F.regexp_replace(compact, r"(?s)^(.{2,})(.{3})\z", "$1 $2")


def looks_like_postcode(text: Column) -> Column:
    """A check of the form only: the postcode need not exist."""
    return coerce.trim(text).rlike(POSTCODE_FORMAT)


def outward_code(text: Column) -> Column:
    return F.substring_index(normalise_postcode(text), " ", 1)


def area_prefix(text: Column) -> Column:
    """The letters a postcode starts with."""
    return F.regexp_extract(outward_code(text), "^[A-Z]*", 0)


# ---- addresses ------------------------------------------------------------


def display_address(line1: Column, line2: Column, town: Column, postcode: Column) -> Column:
    return F.concat_ws(", ", line1, F.nullif(line2, F.lit("")), town, postcode)


def short_address(line1: Column, postcode: Column) -> Column:
    return F.concat_ws(", ", line1, postcode)


# ---- enums ----------------------------------------------------------------


def service_kind(name: Column) -> Column:
    return coerce.enum(name, S.SERVICE_KINDS, "other")


def frequency(name: Column) -> Column:
    return coerce.enum(name, S.FREQUENCIES, "monthly")


def payment_status(name: Column) -> Column:
    return coerce.enum(name, S.PAYMENT_STATUSES, "unknown")


def tenure(name: Column) -> Column:
    return coerce.enum(name, S.TENURES, "other")


def role(name: Column) -> Column:
    return coerce.enum(name, S.ROLES, "owner")


def document_kind(name: Column) -> Column:
    return coerce.enum(name, S.DOCUMENT_KINDS, "other")


def reminder_kind(name: Column) -> Column:
    return coerce.enum(name, S.REMINDER_KINDS, "custom")


def kind_ordinal(kind: Column) -> Column:
    """Position of a service kind in the fixed order, from 0."""
    return F.array_position(coerce.names(S.SERVICE_KINDS), kind) - 1


def setup_rank(kind: Column) -> Column:
    """Rank in the setup list: five kinds first, all others share the last rank."""
    place = F.array_position(coerce.names(S.SETUP_ORDER), kind)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(S.SETUP_ORDER))).cast("bigint")


def kind_label(kind: Column) -> Column:
    known = F.try_element_at(coerce.lookup(S.KIND_LABELS), kind)
    return F.coalesce(known, F.lit(S.KIND_LABELS["other"]))


# ---- roles ----------------------------------------------------------------


def can_edit_bills(role_name: Column) -> Column:
    return role_name.isin("owner", "tenant", "housemate")


def can_manage_household(role_name: Column) -> Column:
    return role_name == "owner"


def can_see_amounts(role_name: Column) -> Column:
    return role_name != "viewer"


def masked_money(minor: Column, role_name: Column) -> Column:
    """Formatted money, or a mask for roles that may not see amounts."""
    return F.when(can_see_amounts(role_name), format_money(minor)).otherwise(F.lit(MASK))
