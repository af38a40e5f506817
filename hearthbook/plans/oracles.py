"""Expected results of the registered queries, as DuckDB SQL on the same Parquet tables.

Written apart from the operators: joins, windows and CASE over the flat derived
tables. Every query of the ledger has an entry.
"""

from __future__ import annotations

from hearthbook.operators.extraction import (
    AMOUNT_LABELS,
    FREQUENCY_WORDS,
    KIND_WORDS,
    KNOWN_PROVIDERS,
    MONTHS,
)
from hearthbook.plans.derived import AS_OF, MONTH, REMINDER_AS_OF, RULES
from hearthbook.schema import SERVICE_KINDS, SETUP_ORDER
from hearthbook.sources.dimensions import LOOKUP_LINKS, SAMPLE_COUNCIL, SAMPLE_WATER

ORACLES: dict[str, str] = {}

_D = f"DATE '{AS_OF}'"


def _with(tables: str, body: str, **extra: str) -> str:
    """A query over derived tables (by name) and further named subqueries."""
    named = {name: RULES[name].sql() for name in tables.split()}
    named.update(extra)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in named.items())
    return f"WITH {ctes}\n{body}" if named else body


def oracle(name: str, tables: str, body: str, **extra: str) -> None:
    ORACLES[name] = _with(tables, body, **extra)


def _case(column: str, pairs: dict[str, object], default: str = "NULL") -> str:
    branches = " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items())
    return f"CASE {column} {branches} ELSE {default} END"


KIND_ORDINAL = _case("kind", {k: i for i, k in enumerate(SERVICE_KINDS)})
KIND_LABEL = (
    "CASE kind WHEN 'electricity' THEN 'Electricity' WHEN 'gas' THEN 'Gas' WHEN 'water' THEN 'Water' "
    "WHEN 'wastewater' THEN 'Wastewater' WHEN 'councilTax' THEN 'Council tax' "
    "WHEN 'broadband' THEN 'Broadband' WHEN 'tvLicence' THEN 'TV Licence' "
    "WHEN 'homeInsurance' THEN 'Home insurance' ELSE 'Other' END"
)
DEFAULT_KEYS = (
    "CASE kind WHEN 'electricity' THEN 'electricity_supplier' WHEN 'gas' THEN 'gas_supplier' "
    "WHEN 'water' THEN 'water_provider' WHEN 'wastewater' THEN 'water_provider' "
    "WHEN 'councilTax' THEN 'council_tax,find_council' WHEN 'tvLicence' THEN 'tv_licence' ELSE '' END"
)
PAID = "payment_status = 'paid'"
EST = "amount_minor_source = 'estimate'"
ACT = "(amount_minor_value IS NOT NULL AND due_date_value IS NOT NULL)"
SURE = "amount_minor_status = 'confirmed' AND amount_minor_value IS NOT NULL"
GAP = f"date_diff('day', {_D}, due_date_value)"
PER_YEAR = (
    "CASE frequency WHEN 'weekly' THEN 52 WHEN 'fortnightly' THEN 26 WHEN 'monthly' THEN 12 "
    "WHEN 'quarterly' THEN 4 WHEN 'annually' THEN 1 ELSE 0 END"
)
MONTHLY = f"CAST(round(CAST(amount_minor_value AS DOUBLE) * ({PER_YEAR}) / 12) AS BIGINT)"
READY = (
    "CASE WHEN provider_value IS NULL THEN 'notFound' WHEN provider_status = 'suggested' "
    "THEN 'needsConfirmation' WHEN amount_minor_value IS NULL OR next_due_date_value IS NULL "
    "THEN 'needsDetails' ELSE 'ready' END"
)


def _state(rest: str) -> str:
    return (
        f"CASE WHEN {PAID} THEN 'paid' WHEN NOT {ACT} THEN 'needsDetails' WHEN {GAP} < 0 THEN 'overdue' "
        f"WHEN {GAP} <= 7 THEN 'dueSoon' ELSE '{rest}' END"
    )


STATE = _state("upcoming")
SECTION = f"CASE WHEN {EST} AND NOT {PAID} THEN 'estimate' ELSE {_state('later')} END"


def _money(column: str, pence: bool = True, symbol: str = "£") -> str:
    whole = (
        f"regexp_replace(CAST(abs({column}) // 100 AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2')"
    )
    # Group by thousands, three times over, from the right.
    for _ in range(4):
        whole = f"regexp_replace({whole}, '^(\\d+)(\\d{{3}})(,|$)', '\\1,\\2\\3')"
    text = f"CASE WHEN {column} < 0 THEN '-' ELSE '' END || '{symbol}' || {whole}"
    if pence:
        text += f" || '.' || lpad(CAST(abs({column}) % 100 AS VARCHAR), 2, '0')"
    return f"CASE WHEN {column} IS NULL THEN '—' ELSE {text} END"


# ---- summary, spending, calendar -------------------------------------------


def _summary(overdue_counts: str) -> str:
    return _with(
        "households service_slots bills",
        f"""SELECT h.household_id,
  CAST(coalesce(monthly, 0) AS BIGINT) AS monthly_recurring_minor,
  coalesce(monthly_n, 0) AS monthly_recurring_count,
  CAST(coalesce(still, 0) AS BIGINT) AS still_to_pay_minor,
  coalesce(still_n, 0) AS still_to_pay_count,
  coalesce(excluded, 0) AS excluded_from_totals,
  coalesce(unresolved, 0) AS unresolved_provider_count,
  coalesce(undated, 0) AS missing_date_count,
  coalesce(overdue, 0) AS overdue_count,
  coalesce(upcoming, 0) AS upcoming_count,
  coalesce(lacking, 0) AS needs_details_count,
  coalesce(est, 0) AS estimate_count,
  coalesce(monthly_n, 0) > 0 OR coalesce(still_n, 0) > 0 AS has_reliable_totals,
  coalesce(excluded, 0) + coalesce(unresolved, 0) + coalesce(overdue, 0) AS attention_count
FROM households h LEFT JOIN s USING (household_id) LEFT JOIN b USING (household_id)""",
        s=f"""SELECT household_id, sum({MONTHLY}) FILTER (rec) AS monthly,
  count(*) FILTER (rec AND {MONTHLY} > 0) AS monthly_n,
  count(*) FILTER (provider_value IS NULL OR provider_status = 'suggested') AS unresolved
FROM (SELECT *, provider_value IS NOT NULL AND {SURE} AND NOT {EST} AS rec FROM service_slots)
GROUP BY household_id""",
        open_bills=f"""SELECT *, {EST} AS is_est, {ACT} AS act, {GAP} AS gap, {SURE} AS sure
FROM bills WHERE NOT {PAID}""",
        b=f"""SELECT household_id,
  sum(amount_minor_value) FILTER (counted) AS still, count(*) FILTER (counted) AS still_n,
  count(*) FILTER (NOT is_est AND (NOT act OR (gap <= 30 AND NOT counted))) AS excluded,
  count(*) FILTER (NOT is_est AND due_date_value IS NULL) AS undated,
  count(*) FILTER (NOT is_est AND act AND gap < 0) AS overdue,
  count(*) FILTER (NOT is_est AND act) AS upcoming,
  count(*) FILTER (NOT is_est AND NOT act) AS lacking,
  count(*) FILTER (is_est) AS est
FROM (SELECT *, NOT is_est AND act AND (({overdue_counts}) OR (gap BETWEEN 0 AND 30 AND sure)) AS counted
      FROM open_bills) GROUP BY household_id""",
    )


ORACLES["household_summary"] = _summary("gap < 0")
ORACLES["household_summary_confirmed_overdue"] = _summary("gap < 0 AND sure")

_SPEND = {
    "spend": f"""SELECT household_id, kind, amount_minor_value AS amount,
  date_trunc('month', coalesce(due_date_value, period_start)) AS month FROM bills WHERE {SURE} AND NOT {EST}""",
    "months": """SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY month DESC) AS rn FROM (
  SELECT household_id, month, CAST(sum(amount) AS BIGINT) AS total_minor, count(*) AS bill_count
  FROM spend WHERE month IS NOT NULL GROUP BY household_id, month)""",
}
oracle(
    "monthly_spend", "bills",
    "SELECT household_id, strftime(month, '%Y-%m-%d') AS month, total_minor, bill_count FROM months WHERE rn <= 6",
    **_SPEND,
)
oracle(
    "month_bar_ratio", "bills",
    """SELECT household_id, strftime(month, '%Y-%m-%d') AS month, total_minor,
  CAST(total_minor AS DOUBLE) / CAST(max(total_minor) OVER (PARTITION BY household_id) AS DOUBLE) AS bar_ratio
FROM (SELECT * FROM months WHERE rn <= 12)""",
    **_SPEND,
)
oracle(
    "spending_totals", "bills",
    """SELECT household_id, CAST(sum(total_minor) AS BIGINT) AS total_minor, max(total_minor) AS largest_minor,
  count(*) AS month_count FROM months WHERE rn <= 12 GROUP BY household_id""",
    **_SPEND,
)
oracle(
    "spend_by_kind_share", "bills",
    f"""SELECT household_id, kind, total_minor,
  CAST(round(CAST(total_minor * 100 AS DOUBLE) / CAST(sum(total_minor) OVER w AS DOUBLE)) AS BIGINT) AS share_percent,
  row_number() OVER (PARTITION BY household_id ORDER BY total_minor DESC, {KIND_ORDINAL}) AS rank
FROM (SELECT household_id, kind, CAST(sum(amount) AS BIGINT) AS total_minor FROM spend GROUP BY household_id, kind)
WINDOW w AS (PARTITION BY household_id)""",
    spend=_SPEND["spend"],
)
_IN_MONTH = f"date_trunc('month', due_date_value) = DATE '{MONTH}'"
_DAY_SUMS = f"""count(*) AS bill_count,
  CAST(coalesce(sum(amount_minor_value) FILTER (NOT {PAID} AND {SURE} AND NOT {EST}), 0) AS BIGINT) AS confirmed_minor,
  count(*) FILTER (NOT {PAID} AND NOT ({SURE} AND NOT {EST})) AS unconfirmed_count"""
oracle(
    "calendar_month", "bills",
    f"""SELECT household_id, CAST(due_date_value AS VARCHAR) AS day, {_DAY_SUMS},
  CASE WHEN bool_or({SURE} AND NOT {EST}) THEN 'confirmed' ELSE 'other' END AS marker
FROM bills WHERE {_IN_MONTH} GROUP BY household_id, due_date_value""",
)
oracle(
    "calendar_month_totals", "bills",
    f"SELECT household_id, {_DAY_SUMS} FROM bills WHERE {_IN_MONTH} GROUP BY household_id",
)
oracle(
    "calendar_day_bills", "bills",
    f"SELECT household_id, bill_id, CAST(due_date_value AS VARCHAR) AS day FROM bills WHERE {_IN_MONTH}",
)
oracle(
    "calendar_spine", "households bills",
    f"""SELECT g.household_id, CAST(d AS VARCHAR) AS day,
  (isodow(DATE '{MONTH}') - 1) + day(d) - 1 AS grid_cell, count(bill_id) AS bill_count,
  CASE WHEN coalesce(bool_or({SURE} AND NOT {EST}), false) THEN 'confirmed'
       WHEN count(bill_id) > 0 THEN 'other' ELSE 'none' END AS marker
FROM grid g LEFT JOIN bills b ON b.household_id = g.household_id AND b.due_date_value = g.d
GROUP BY g.household_id, d""",
    grid=f"""SELECT household_id, CAST(unnest(generate_series(DATE '{MONTH}',
  DATE '{MONTH}' + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM households""",
)
oracle(
    "due_next_7_days", "bills",
    f"""SELECT bill_id, household_id, CAST(due_date_value AS VARCHAR) AS due FROM bills
WHERE NOT {PAID} AND {GAP} BETWEEN 0 AND 7""",
)

# ---- bill rules and lists ---------------------------------------------------

oracle(
    "bill_states", "bills",
    f"""SELECT bill_id, {PAID} AS paid, {EST} AS estimate, {SURE} AND NOT {EST} AS confirmed_amount,
  {ACT} AS actionable, coalesce(NOT {PAID} AND {GAP} < 0, false) AS overdue,
  coalesce(NOT {PAID} AND {GAP} BETWEEN 0 AND 30, false) AS due_in_30, {STATE} AS state FROM bills""",
)
oracle(
    "bill_sections", "bills",
    f"SELECT household_id, {SECTION} AS section, count(*) AS bill_count FROM bills GROUP BY 1, 2",
)
oracle("bill_filter_to_pay", "bills",
       f"SELECT household_id, bill_id FROM bills WHERE NOT {PAID} AND {ACT} AND NOT {EST}")
oracle("bill_filter_needs_details", "bills",
       f"SELECT household_id, bill_id FROM bills WHERE NOT {PAID} AND (NOT {ACT} OR {EST})")
oracle("bill_filter_paid", "bills", f"SELECT household_id, bill_id FROM bills WHERE {PAID}")
_LABEL = f"""CASE WHEN {GAP} = 0 THEN 'Due today' WHEN {GAP} = 1 THEN 'Due tomorrow' WHEN {GAP} = -1 THEN '1 day late'
  WHEN {GAP} < 0 THEN CAST(-{GAP} AS VARCHAR) || ' days late' WHEN {GAP} < 7 THEN 'Due in ' || CAST({GAP} AS VARCHAR) || ' days'
  ELSE 'Due ' || strftime(due_date_value, '%-d %b') END"""
oracle(
    "bill_tiles", "bills",
    f"""SELECT bill_id, household_id,
  CASE WHEN {EST} AND NOT {PAID} THEN 'needsDetails' ELSE {STATE} END AS display_state,
  CASE WHEN {EST} THEN 'estimate: ' ELSE '' END || CASE WHEN {PAID} THEN 'paid'
    WHEN due_date_value IS NULL THEN 'date_missing' WHEN amount_minor_value IS NULL THEN 'amount_missing'
    ELSE {_LABEL} END AS when_text,
  coalesce(provider_value, 'not_recorded') AS provider_text,
  {_money('amount_minor_value')} AS amount_text,
  strftime(due_date_value, '%-d %b') AS date_text FROM bills""",
)
oracle("bills_by_date", "bills",
       "SELECT household_id, bill_id, CAST(due_date_value AS VARCHAR) AS due_date_value FROM bills")
oracle(
    "upcoming_top5", "bills",
    f"""SELECT household_id, bill_id, CAST(due_date_value AS VARCHAR) AS due_date_value, position FROM (
  SELECT *, row_number() OVER (PARTITION BY household_id ORDER BY due_date_value, bill_id) AS position
  FROM bills WHERE NOT {PAID} AND NOT {EST} AND {ACT}) WHERE position <= 5""",
)
oracle(
    "needs_details_list", "bills",
    f"""SELECT household_id, bill_id, CAST({KIND_ORDINAL} AS BIGINT) AS kind_ordinal
FROM bills WHERE NOT {PAID} AND NOT {EST} AND NOT {ACT}""",
)
oracle(
    "estimates_list", "bills",
    f"""SELECT household_id, bill_id, CAST(due_date_value AS VARCHAR) AS due_date_value, amount_minor_value
FROM bills WHERE NOT {PAID} AND {EST}""",
)
oracle(
    "reminders_open", "reminders",
    f"""SELECT household_id, reminder_id, CAST(due_at AS VARCHAR) AS due_at, due_at < DATE '{REMINDER_AS_OF}' AS overdue
FROM reminders WHERE NOT is_done""",
)
oracle("reminders_done", "reminders", "SELECT household_id, reminder_id, kind FROM reminders WHERE is_done")

# ---- services ---------------------------------------------------------------

oracle(
    "service_readiness", "service_slots",
    f"""SELECT slot_id, household_id, kind, {READY} AS readiness,
  CASE WHEN provider_value IS NULL THEN 'find_provider' WHEN provider_status = 'suggested' THEN 'confirm_provider'
    WHEN amount_minor_value IS NULL THEN 'add_amount' WHEN next_due_date_value IS NULL THEN 'add_date'
    ELSE 'none' END AS next_action FROM service_slots""",
)
oracle(
    "services_outstanding", "households service_slots",
    f"""SELECT h.household_id, count(slot_id) AS service_count,
  count(*) FILTER (slot_id IS NOT NULL AND {READY} <> 'ready') AS outstanding_count,
  count(provider_value) = 0 AS nothing_discovered
FROM households h LEFT JOIN service_slots s ON s.household_id = h.household_id GROUP BY h.household_id""",
)
oracle(
    "household_stages", "households properties",
    """SELECT h.household_id, CASE WHEN p.property_id IS NULL THEN 'setup' WHEN NOT onboarding_complete THEN 'confirm'
  ELSE 'active' END AS stage FROM households h LEFT JOIN properties p USING (household_id)""",
)
oracle(
    "household_counts", "households members documents_ledger",
    """SELECT household_id, (SELECT count(*) FROM members m WHERE m.household_id = h.household_id) AS member_count,
  (SELECT count(*) FROM documents_ledger d WHERE d.household_id = h.household_id) AS document_count FROM households h""",
)
oracle(
    "setup_order", "service_slots",
    f"SELECT household_id, kind, CAST({_case('kind', {k: i for i, k in enumerate(SETUP_ORDER)}, '5')} AS BIGINT) AS setup_rank FROM service_slots",
)
oracle(
    "monthly_equivalents", "service_slots",
    f"""SELECT slot_id, CAST({PER_YEAR} AS BIGINT) AS per_year, coalesce({MONTHLY}, 0) AS monthly_minor,
  coalesce(-{MONTHLY}, 0) AS monthly_refund_minor FROM service_slots""",
)

# ---- fields -----------------------------------------------------------------

oracle(
    "field_states", "bills",
    """SELECT bill_id, amount_minor_value IS NOT NULL AS has_value,
  amount_minor_status = 'confirmed' AS is_confirmed, amount_minor_status = 'suggested' AS needs_confirmation,
  amount_minor_source IN ('billExtraction', 'estimate') AS is_automatic,
  amount_minor_source = 'userEntered' AS is_human_confirmed,
  CASE WHEN amount_minor_value IS NULL THEN 'notRecorded' WHEN amount_minor_source = 'estimate' THEN 'estimate'
    WHEN amount_minor_status = 'suggested' THEN 'suggested:' || amount_minor_source
    ELSE amount_minor_source END AS provenance FROM bills""",
)
oracle(
    "field_transitions", "service_slots",
    """SELECT slot_id,
  provider_value AS confirmed_value,
  CASE WHEN provider_value IS NULL THEN 'none' ELSE 'userConfirmed' END AS confirmed_source,
  CASE WHEN provider_value IS NULL THEN 'missing' ELSE 'confirmed' END AS confirmed_status,
  CAST(NULL AS VARCHAR) AS confirmed_note,
  CAST(NULL AS VARCHAR) AS rejected_value, 'none' AS rejected_source, 'missing' AS rejected_status,
  'rejected: ' || coalesce(provider_value, '') AS rejected_note,
  'My ' || kind AS edited_value, 'userEntered' AS edited_source, 'confirmed' AS edited_status,
  CAST(NULL AS VARCHAR) AS edited_note,
  provider_value AS noted_value, provider_source AS noted_source, provider_status AS noted_status, 'seen' AS noted_note,
  provider_value AS offered_value,
  CASE WHEN provider_value IS NULL THEN 'none' ELSE 'officialLookup' END AS offered_source,
  CASE WHEN provider_value IS NULL THEN 'missing' ELSE 'suggested' END AS offered_status,
  CASE WHEN provider_value IS NULL THEN NULL ELSE 'from register' END AS offered_note
FROM service_slots""",
)
oracle(
    "mixed_field_input", "",
    """SELECT o_orderkey,
  CASE WHEN o_orderkey % 6 IN (1, 2, 3) THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS amount_minor_value,
  CASE o_orderkey % 6 WHEN 1 THEN 'userEntered' WHEN 2 THEN 'userEntered' WHEN 3 THEN 'estimate' ELSE 'none' END AS amount_minor_source,
  CASE o_orderkey % 6 WHEN 1 THEN 'confirmed' WHEN 2 THEN 'confirmed' WHEN 3 THEN 'suggested' ELSE 'missing' END AS amount_minor_status
FROM orders""",
)
oracle(
    "field_violations", "bills",
    """SELECT bill_id, CASE k % 4
  WHEN 0 THEN CASE WHEN amount_minor_value IS NULL THEN '' ELSE 'value_without_status' END
  WHEN 1 THEN CASE WHEN amount_minor_status = 'missing' THEN '' ELSE 'status_without_value' END
  WHEN 2 THEN 'unknown_source' ELSE '' END AS codes
FROM (SELECT *, CAST(substr(bill_id, 3) AS BIGINT) AS k FROM bills)""",
)

# ---- scalars ----------------------------------------------------------------

oracle(
    "money_parsing", "",
    """SELECT o_orderkey, minor, CASE WHEN minor IS NULL THEN 'unreadable' WHEN minor <= 0 THEN 'not_positive'
  WHEN minor > 100000000 THEN 'too_large' ELSE '' END AS codes
FROM (SELECT o_orderkey, CASE o_orderkey % 7
    WHEN 1 THEN CAST(round(o_totalprice * 100) AS BIGINT)
    WHEN 2 THEN (1000 + o_orderkey % 1000) * 100 + 50
    WHEN 3 THEN (o_orderkey % 50) * 100
    WHEN 4 THEN -CAST(round(o_totalprice * 100) AS BIGINT)
    WHEN 6 THEN CAST(round(CAST(CAST(o_orderkey * 1000 AS VARCHAR) || '.005' AS DOUBLE) * 100) AS BIGINT)
    END AS minor FROM orders)""",
)
oracle(
    "money_formatting", "",
    f"""SELECT c_custkey, {_money('shown')} AS with_pence, {_money('shown', False, '')} AS whole FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT)
    * CAST(power(10, c_custkey % 4) AS BIGINT) END AS shown FROM customer)""",
)
oracle(
    "due_labels", "bills",
    f"""SELECT bill_id, {GAP} AS days, {_LABEL} AS label,
  strftime(due_date_value, '%-d %B %Y') AS long, strftime(due_date_value, '%-d %b') AS short,
  strftime(due_date_value, '%B %Y') AS month_year, strftime(due_date_value, '%-d %b %Y') AS compact,
  strftime(due_date_value, '%Y-%m-%d') AS iso, strftime(due_date_value, '%B') AS month,
  strftime(due_date_value, '%a') AS weekday FROM bills WHERE due_date_value IS NOT NULL""",
)
_NORMAL = (
    "CASE WHEN length({c}) < 5 THEN {c} ELSE left({c}, length({c}) - 3) || ' ' || right({c}, 3) END".format(
        c="upper(regexp_replace(postcode, '\\s+', '', 'g'))"
    )
)
oracle(
    "postcodes", "properties",
    f"""SELECT property_id, normalised,
  regexp_full_match(trim(postcode), '(?i)[A-Z]{{1,2}}[0-9][A-Z0-9]?\\s?[0-9][A-Z]{{2}}') AS well_formed,
  string_split(normalised, ' ')[1] AS outward,
  regexp_extract(string_split(normalised, ' ')[1], '^[A-Z]*') AS prefix
FROM (SELECT *, {_NORMAL} AS normalised FROM properties)""",
)
oracle(
    "address_lines", "properties",
    """SELECT property_id, concat_ws(', ', line1, nullif(line2, ''), town, postcode) AS display_address,
  line1 || ', ' || postcode AS short_address FROM properties""",
)
oracle(
    "tolerant_coercions", "",
    """SELECT event_id,
  CASE k WHEN 0 THEN n WHEN 1 THEN n || '.75' WHEN 2 THEN n WHEN 3 THEN 'true' WHEN 4 THEN 'true'
    WHEN 8 THEN d || 'T10:20:30Z' ELSE '' END AS as_string,
  CASE WHEN k IN (0, 1, 2) THEN CAST(n AS BIGINT) END AS as_int,
  CASE WHEN k IN (0, 2) THEN CAST(n AS DOUBLE) WHEN k = 1 THEN CAST(n || '.75' AS DOUBLE) END AS as_double,
  CASE k WHEN 0 THEN n <> '0' WHEN 1 THEN true WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS as_bool,
  CASE WHEN k = 8 THEN d END AS as_date,
  CASE WHEN k = 8 THEN d || ' 10:20:30' END AS as_timestamp,
  k = 6 AS is_map, CASE WHEN k = 7 THEN 'a|' || n || '|true' ELSE '' END AS as_string_list
FROM (SELECT event_id, event_id % 9 AS k, CAST(event_id % 1000 AS VARCHAR) AS n,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events)""",
)
oracle(
    "enum_fallbacks", "",
    """SELECT event_id, CASE WHEN name = 'gas' THEN 'gas' ELSE 'other' END AS kind,
  CASE WHEN name = 'weekly' THEN 'weekly' ELSE 'monthly' END AS frequency,
  CASE WHEN name = 'paid' THEN 'paid' ELSE 'unknown' END AS payment_status,
  CASE WHEN name = 'owning' THEN 'owning' ELSE 'other' END AS tenure,
  CASE WHEN name = 'viewer' THEN 'viewer' ELSE 'owner' END AS role,
  CASE WHEN name = 'policy' THEN 'policy' ELSE 'other' END AS document_kind,
  CASE WHEN name = 'payment' THEN 'payment' ELSE 'custom' END AS reminder_kind
FROM (SELECT event_id, CASE WHEN event_id % 2 = 1 THEN
  ['gas', 'weekly', 'paid', 'owning', 'viewer', 'policy', 'payment'][event_id % 7 + 1] END AS name FROM events)""",
)

# ---- discovery and relations -------------------------------------------------


def _values(rows: list[tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_DISCOVERY = {
    "areas": "SELECT * FROM ("
    + _values(
        [(p, "water", v, "areaCertain", "water_provider") for p, v in SAMPLE_WATER.items()]
        + [(p, "wastewater", v, "areaOnly", "water_provider") for p, v in SAMPLE_WATER.items()]
        + [(p, "councilTax", v, "areaCertain", "council_tax,find_council") for p, v in SAMPLE_COUNCIL.items()]
    )
    + ") AS v(prefix, kind, provider, confidence, lookup_keys)",
    "suggestions": """SELECT household_id, kind, provider, confidence, lookup_keys
FROM (SELECT household_id, CAST(substr(property_id, 6) AS BIGINT) % 8 AS place FROM properties)
JOIN areas ON CASE WHEN place IN (0, 7) THEN 'BS' WHEN place = 1 THEN 'CF'
  WHEN place = 2 THEN 'LS' WHEN place = 3 THEN 'M' WHEN place = 4 THEN 'SW' END = prefix
UNION ALL SELECT household_id, 'electricity', NULL, 'unknown', 'electricity_supplier' FROM properties
UNION ALL SELECT household_id, 'gas', NULL, 'unknown', 'gas_supplier' FROM properties""",
}
oracle(
    "provider_discovery", "properties",
    """SELECT household_id, kind, provider AS provider_value,
  CASE WHEN provider IS NULL THEN 'none' ELSE 'postcodeLookup' END AS provider_source,
  CASE WHEN provider IS NULL THEN 'missing' ELSE 'suggested' END AS provider_status,
  CASE WHEN provider IS NOT NULL THEN '2026-01-03 10:00:00' END AS provider_recorded_at, confidence, lookup_keys
FROM suggestions""",
    **_DISCOVERY,
)
_SEVERAL = {
    "areas": """SELECT prefix, kind, count(DISTINCT provider) AS provider_count, min(provider) AS provider,
  min(lookup_key) AS lookup_keys FROM areas_by_supplier GROUP BY prefix, kind""",
    "asked": """SELECT household_id, CASE CAST(substr(property_id, 6) AS BIGINT) % 8 WHEN 0 THEN 'BS' WHEN 7 THEN 'BS' WHEN 1 THEN 'CF'
  WHEN 2 THEN 'LS' WHEN 3 THEN 'M' WHEN 4 THEN 'SW' WHEN 5 THEN 'EH' END AS prefix FROM properties""",
    "offers": """SELECT household_id, kind, CASE WHEN provider_count = 1 THEN provider END AS provider, lookup_keys FROM asked JOIN areas USING (prefix)
UNION ALL SELECT household_id, 'electricity', NULL, 'electricity_supplier' FROM asked
UNION ALL SELECT household_id, 'gas', NULL, 'gas_supplier' FROM asked""",
}
oracle(
    "ambiguous_areas", "areas_by_supplier",
    """SELECT DISTINCT prefix, kind, provider_count, b.provider FROM areas_by_supplier b
JOIN (SELECT prefix, kind, provider_count FROM areas WHERE provider_count > 1) USING (prefix, kind)""",
    areas=_SEVERAL["areas"],
)
oracle(
    "provider_discovery_several", "properties areas_by_supplier",
    """SELECT household_id, kind, provider AS provider_value,
  CASE WHEN provider IS NULL THEN 'none' ELSE 'postcodeLookup' END AS provider_source,
  CASE WHEN provider IS NULL THEN 'missing' ELSE 'suggested' END AS provider_status,
  CASE WHEN provider IS NOT NULL THEN '2026-01-03 10:00:00' END AS provider_recorded_at,
  CASE WHEN provider IS NULL THEN 'unknown' ELSE 'areaCertain' END AS confidence, lookup_keys FROM offers""",
    **_SEVERAL,
)
_MERGED = {
    **_DISCOVERY,
    "merged": """SELECT s.*, g.provider, g.lookup_keys,
  g.provider IS NOT NULL AND provider_source NOT IN ('userEntered', 'userConfirmed') AND provider_status <> 'confirmed' AS applied
FROM service_slots s LEFT JOIN suggestions g ON g.household_id = s.household_id AND g.kind = s.kind""",
}
oracle(
    "apply_suggestions", "properties service_slots",
    """SELECT slot_id, CASE WHEN applied THEN provider ELSE provider_value END AS provider_value,
  CASE WHEN applied THEN 'postcodeLookup' ELSE provider_source END AS provider_source,
  CASE WHEN applied THEN 'suggested' ELSE provider_status END AS provider_status,
  CASE WHEN applied THEN '2026-01-03 10:00:00' END AS provider_recorded_at,
  CASE WHEN applied AND lookup_keys_text = '' THEN lookup_keys ELSE lookup_keys_text END AS lookup_keys,
  coalesce(applied, false) AS applied FROM merged""",
    **_MERGED,
)
oracle(
    "applied_suggestion_counts", "properties service_slots",
    "SELECT household_id, count(*) FILTER (applied) AS applied_count FROM merged GROUP BY household_id",
    **_MERGED,
)
oracle(
    "missing_kinds", "households service_slots",
    """SELECT household_id, kind FROM households, kinds
WHERE NOT EXISTS (SELECT 1 FROM service_slots s WHERE s.household_id = households.household_id AND s.kind = kinds.kind)""",
    kinds="SELECT * FROM (" + _values([(k,) for k in SERVICE_KINDS]) + ") AS v(kind)",
)
oracle(
    "kinds_still_needed", "properties service_slots",
    """SELECT household_id, kind FROM service_slots s WHERE NOT EXISTS (SELECT 1 FROM suggestions g
  WHERE g.provider IS NOT NULL AND g.household_id = s.household_id AND g.kind = s.kind)""",
    **_DISCOVERY,
)
oracle(
    "households_without_property", "households properties",
    "SELECT household_id FROM households WHERE household_id NOT IN (SELECT household_id FROM properties)",
)
oracle(
    "address_search", "address_requests addresses",
    f"""SELECT request_id, a.postcode, line1, town, a.uprn
FROM (SELECT request_id, {_NORMAL} AS postcode FROM address_requests) r JOIN addresses a ON a.postcode = r.postcode""",
)
oracle(
    "address_unmatched", "address_requests addresses",
    f"""SELECT request_id, CASE WHEN request_id % 9 = 0 THEN 'not_a_postcode' ELSE 'no_address' END AS reason
FROM (SELECT request_id, {_NORMAL} AS postcode FROM address_requests) r
WHERE NOT EXISTS (SELECT 1 FROM addresses a WHERE a.postcode = r.postcode)""",
)
oracle(
    "address_by_uprn", "address_requests addresses",
    "SELECT request_id, r.uprn, line1, a.postcode FROM address_requests r JOIN addresses a ON a.uprn = r.uprn",
)
oracle(
    "slot_links", "service_slots",
    """SELECT slot_id, pos - 1 AS pos, key, title, operator, url FROM (
  SELECT slot_id, unnest(keys) AS key, unnest(range(1, len(keys) + 1)) AS pos
  FROM (SELECT slot_id, string_split(lookup_keys_text, ',') AS keys FROM service_slots WHERE lookup_keys_text <> '')
) JOIN links USING (key)""",
    links="SELECT * FROM (" + _values([(k, *v) for k, v in LOOKUP_LINKS.items()]) + ") AS v(key, title, operator, url)",
)
oracle(
    "service_for_bill", "bills service_slots",
    """SELECT bill_id, b.household_id, b.kind, slot_id FROM bills b
LEFT JOIN service_slots s ON s.household_id = b.household_id AND s.kind = b.kind""",
)
oracle(
    "bill_documents", "bills documents_ledger",
    """SELECT bill_id, b.household_id, document_id, title, d.provider_name FROM bills b
LEFT JOIN (SELECT document_id, title, provider_name FROM documents_ledger) d USING (document_id)""",
)
oracle(
    "broken_links", "bills documents_ledger",
    """SELECT bill_id AS from_id, document_id AS to_id, 'bill_to_document' AS link FROM bills
WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM documents_ledger)
UNION ALL SELECT document_id, bill_id, 'document_to_bill' FROM documents_ledger
WHERE bill_id NOT IN (SELECT bill_id FROM bills)""",
)
_CURRENT = {
    "acting": """SELECT h.household_id, m.member_id, m.role FROM households h JOIN members m
  ON m.household_id = h.household_id AND m.pos = CASE WHEN h.current_member_id = 'gone' THEN 0 ELSE h.household_id % 2 END"""
}
oracle(
    "current_members", "households members",
    """SELECT household_id, member_id, role, role <> 'viewer' AS can_edit_bills, role = 'owner' AS can_manage_household,
  role <> 'viewer' AS can_see_amounts FROM acting""",
    **_CURRENT,
)
oracle(
    "role_masked_bills", "households members bills",
    f"""SELECT bill_id, b.household_id, role,
  CASE WHEN role = 'viewer' THEN '••••' ELSE {_money('amount_minor_value')} END AS amount_text
FROM bills b JOIN acting a ON a.household_id = b.household_id""",
    **_CURRENT,
)
oracle(
    "requested_services", "household_requests",
    """SELECT household_id, CAST(pos AS BIGINT) AS pos, kind, unknown FROM household_requests JOIN (VALUES
  ('gas,water,gas', 0, 'gas', ''), ('gas,water,gas', 1, 'water', ''),
  ('broadband,tvLicence,other', 0, 'broadband', ''), ('broadband,tvLicence,other', 1, 'tvLicence', ''),
  ('broadband,tvLicence,other', 2, 'other', ''),
  ('water,solar,solar,gas', 0, 'water', 'solar'), ('water,solar,solar,gas', 1, 'solar', 'solar'),
  ('water,solar,solar,gas', 2, 'gas', 'solar'),
  ('councilTax,electricity', 0, 'councilTax', ''), ('councilTax,electricity', 1, 'electricity', '')
) AS v(services_text, pos, kind, unknown) USING (services_text)""",
)

# ---- text extraction ---------------------------------------------------------

# RE2 forms of the extraction patterns; white space listed as code points.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(column: str) -> str:
    return f"regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g')"


_DIGITS = r"[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}"
_DUE = (
    r"(?:due date|due on|due by|payment due|please pay by|pay by|instalment due|next payment|due\b)"
    rf"{_WS}*[^0-9]{{0,24}}({_DIGITS}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    rf"|[0-9]{{1,2}}(?:st|nd|rd|th)?{_WS}+(?:of{_WS}+)?[A-Za-z]{{3,9}}{_WS}+[0-9]{{2,4}}"
    rf"|[A-Za-z]{{3,9}}{_WS}+[0-9]{{1,2}}(?:st|nd|rd|th)?,?{_WS}+[0-9]{{2,4}})"
)
_LOOSE = rf"due[^0-9A-Za-z]{{0,8}}({_DIGITS})"
_DAY_NAME = rf"^([0-9]{{1,2}})(?:st|nd|rd|th)?{_WS}+(?:of{_WS}+)?([a-z]{{3,9}})\.?{_WS}+([0-9]{{2,4}})$"
_NAME_DAY = rf"^([a-z]{{3,9}})\.?{_WS}+([0-9]{{1,2}})(?:st|nd|rd|th)?{_WS}+([0-9]{{2,4}})$"
_NUMERIC = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})$"
_MONTH_NO = (
    "CASE "
    + " ".join(f"WHEN {{m}} IN ('{m}', '{m[:3]}') THEN {i}" for i, m in enumerate(MONTHS, 1))
    + " WHEN {m} = 'sept' THEN 9 END"
)


def _build_date(year: str, month: str, day: str) -> str:
    return (
        f"try_cast(lpad(CAST({year} AS VARCHAR), 4, '0') || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') "
        f"|| '-' || lpad(CAST({day} AS VARCHAR), 2, '0') AS DATE)"
    )


def _date_of(value: str) -> str:
    """The printed date in lowered, trimmed text without commas; 2026 is the year of reference."""

    def group(pattern: str, number: int) -> str:
        return f"regexp_extract({value}, '{pattern}', {number})"

    def whole(pattern: str, number: int) -> str:
        return f"try_cast({group(pattern, number)} AS INT)"

    year = whole(_NUMERIC, 3)
    numeric_year = (
        f"CASE WHEN {year} >= 100 THEN {year} WHEN {year} + 2000 < 2021 THEN {year} + 2100 ELSE {year} + 2000 END"
    )

    def worded(pattern: str, day: int, month: int) -> str:
        printed = whole(pattern, 3)
        return _build_date(
            f"CASE WHEN {printed} < 100 THEN {printed} + 2000 ELSE {printed} END",
            _MONTH_NO.format(m=group(pattern, month)),
            group(pattern, day),
        )

    return (
        f"CASE WHEN regexp_matches({value}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({value} AS DATE) "
        f"WHEN regexp_matches({value}, '{_NUMERIC}') THEN {_build_date(numeric_year, whole(_NUMERIC, 2), whole(_NUMERIC, 1))} "
        f"WHEN regexp_matches({value}, '{_DAY_NAME}') THEN {worded(_DAY_NAME, 1, 2)} "
        f"WHEN regexp_matches({value}, '{_NAME_DAY}') THEN {worded(_NAME_DAY, 2, 1)} END"
    )


def _tidy(column: str) -> str:
    return f"replace(lower({_trim(column)}), ',', '')"


def _keywords(rules: dict[str, tuple[str, ...]]) -> str:
    branches = [
        "WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{result}'"
        for result, words in rules.items()
    ]
    return "CASE " + " ".join(branches) + " END"


_PRIORITY = (
    "CASE "
    + " ".join(f"WHEN contains(lower(line), '{label}') THEN {i}" for i, label in enumerate(AMOUNT_LABELS))
    + " END"
)
_PROVIDER = "CASE " + " ".join(f"WHEN contains(low, '{n.lower()}') THEN '{n}'" for n in KNOWN_PROVIDERS) + " END"


def _extraction(source: str) -> dict[str, str]:
    """Subqueries that read bills from ``source(id, text)``, ending in ``found``."""
    return {
        "t": f"SELECT id, replace(text, chr(13) || chr(10), chr(10)) AS txt, "
        f"lower(replace(text, chr(13) || chr(10), chr(10))) AS low FROM ({source})",
        "line_list": "SELECT id, string_split(txt, chr(10)) AS lines FROM t",
        "lines": "SELECT id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM line_list",
        "hits": f"SELECT id, i, line, regexp_extract_all(line, '£{_WS}?([0-9][0-9,]*\\.?[0-9]{{0,2}})', 1) AS m "
        "FROM lines WHERE contains(line, '£')",
        "amounts": f"SELECT id, i, {_PRIORITY} AS priority, unnest(m) AS printed, "
        "unnest(range(1, len(m) + 1)) AS j FROM hits",
        "minor": "SELECT *, CAST(round(CAST(replace(printed, ',', '') AS DOUBLE) * 100) AS BIGINT) AS minor FROM amounts",
        "best": "SELECT id, first(minor ORDER BY priority, i, j) FILTER (priority IS NOT NULL) AS labelled, "
        "max(minor) AS largest, count(*) AS n FROM minor GROUP BY id",
        "dates": f"SELECT id, regexp_extract(txt, '{_DUE}', 1, 'i') AS strict, "
        f"regexp_extract(txt, '{_LOOSE}', 1, 'i') AS loose FROM t",
        "due": f"SELECT id, strict, {_date_of('ts')} AS strict_date, {_date_of('tl')} AS loose_date "
        f"FROM (SELECT *, {_tidy('strict')} AS ts, {_tidy('loose')} AS tl FROM dates)",
        "found": f"""SELECT t.id, known, CASE WHEN known IS NULL AND length(word) >= 3 THEN word END AS word,
  coalesce(known, CASE WHEN length(word) >= 3 THEN word END) AS provider,
  labelled, coalesce(labelled, largest) AS amount, coalesce(n, 0) AS n,
  strict, strict_date, coalesce(strict_date, loose_date) AS due,
  {_keywords(KIND_WORDS)} AS kind, {_keywords(FREQUENCY_WORDS)} AS frequency
FROM (SELECT *, {_PROVIDER} AS known, regexp_extract(txt, 'Provider:{_WS}*(\\w+)', 1) AS word FROM t) t
LEFT JOIN best USING (id) JOIN due USING (id)""",
        "coded": """SELECT *, concat_ws(',',
  CASE WHEN known IS NULL AND word IS NOT NULL THEN 'provider_from_label' END,
  CASE WHEN labelled IS NULL AND n > 1 THEN 'several_amounts' END,
  CASE WHEN labelled IS NULL AND n = 1 THEN 'single_unlabelled_amount' END,
  CASE WHEN strict <> '' AND strict_date IS NULL THEN 'unreadable_date' END,
  CASE WHEN provider IS NULL THEN 'missing_provider' END,
  CASE WHEN amount IS NULL THEN 'missing_amount' END,
  CASE WHEN due IS NULL THEN 'missing_date' END) AS warnings FROM found""",
    }


_TEXTS = _extraction(
    f"SELECT document_id AS id, text FROM bill_texts WHERE length({_trim('text')}) >= 20"
)


def _suggested(value: str, note: str, name: str) -> str:
    return (
        f"{value} AS {name}_value, CASE WHEN {value} IS NULL THEN 'missing' ELSE 'suggested' END AS {name}_status, "
        f"CASE WHEN {value} IS NOT NULL THEN {note} END AS {name}_note, "
        f"CASE WHEN {value} IS NOT NULL THEN '2026-01-03 10:00:00' END AS {name}_recorded_at"
    )


oracle(
    "bill_text_lines", "bill_texts",
    f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS pos, line FROM (
  SELECT id AS document_id, i, {_trim('line')} AS line FROM lines) WHERE line <> ''""",
    **{k: v for k, v in _extraction("SELECT document_id AS id, text FROM bill_texts").items()
       if k in ("t", "line_list", "lines")},
)
oracle(
    "extract_provider", "bill_texts",
    "SELECT id AS document_id, "
    + _suggested("provider", "CASE WHEN known IS NULL THEN 'label' ELSE 'name_list' END", "provider")
    + " FROM found",
    **_TEXTS,
)
oracle(
    "extract_amount", "bill_texts",
    "SELECT id AS document_id, "
    + _suggested("amount", "CASE WHEN labelled IS NULL THEN 'largest' ELSE 'labelled' END", "amount_minor")
    + " FROM found",
    **_TEXTS,
)
oracle(
    "extract_due_date", "bill_texts",
    "SELECT id AS document_id, "
    + _suggested("CAST(due AS VARCHAR)", "CASE WHEN strict_date IS NULL THEN 'loose' ELSE 'due_line' END", "due_date")
    + " FROM found",
    **_TEXTS,
)
oracle(
    "extract_kind_frequency", "bill_texts",
    "SELECT id AS document_id, kind AS detected_kind, frequency FROM found",
    **_TEXTS,
)
_ALONE = "CASE " + " ".join(
    f"WHEN regexp_matches(txt, '(^|[^\\w]){n.replace('.', chr(92) + '.')}($|[^\\w])', 'i') THEN '{n}'" for n in KNOWN_PROVIDERS
) + " END"
oracle(
    "extract_provider_whole_words", "",
    """SELECT id AS doc_id, provider AS provider_value,
  CASE WHEN provider IS NOT NULL THEN CASE WHEN known IS NULL THEN 'label' ELSE 'name_list' END END AS provider_note
FROM (SELECT id, known, coalesce(known, CASE WHEN length(word) >= 3 THEN word END) AS provider FROM named)""",
    t="SELECT doc_id AS id, replace(text, chr(13) || chr(10), chr(10)) AS txt FROM documents",
    named=f"SELECT id, {_ALONE} AS known, regexp_extract(txt, 'Provider:{_WS}*(\\w+)', 1) AS word FROM t",
)
oracle(
    "extract_kind_with_hint", "bill_texts",
    """SELECT id AS document_id, CASE WHEN order_key % 3 = 0 THEN 'broadband' ELSE kind END AS detected_kind
FROM found JOIN (SELECT document_id, order_key FROM bill_texts) ON document_id = id""",
    **_TEXTS,
)
_FIELDS = "CAST((provider IS NOT NULL)::INT + (amount IS NOT NULL)::INT + (due IS NOT NULL)::INT AS BIGINT)"
oracle(
    "extract_warnings", "bill_texts",
    f"SELECT id AS document_id, warnings, {_FIELDS} AS fields FROM coded",
    **_TEXTS,
)
oracle(
    "extract_rejects", "bill_texts",
    f"SELECT document_id FROM bill_texts WHERE length({_trim('text')}) < 20",
)
oracle(
    "extraction_coverage", "bill_texts",
    f"""SELECT household_id % 10 AS bucket, count(*) AS document_count, count(*) FILTER (f > 0) AS with_anything,
  CAST(sum(f) AS BIGINT) AS fields_found FROM (SELECT id, {_FIELDS} AS f FROM found)
JOIN bill_texts ON document_id = id GROUP BY 1""",
    **_TEXTS,
)
oracle(
    "extract_document_corpus", "",
    """SELECT id AS doc_id, provider AS provider_value, amount AS amount_minor_value,
  CAST(due AS VARCHAR) AS due_date_value, kind AS detected_kind, frequency, warnings FROM coded""",
    **_extraction("SELECT doc_id AS id, text FROM documents"),
)
_DECIDED = {
    **_TEXTS,
    "joined": """SELECT f.id AS document_id, household_id,
  CASE WHEN k % 4 = 0 THEN 'gas' ELSE coalesce(kind, 'other') END AS kind,
  CASE WHEN k % 6 = 0 THEN 'Chosen Ltd' ELSE provider END AS provider,
  CASE WHEN k % 10 = 0 THEN 1234 WHEN k % 10 = 2 THEN NULL ELSE amount END AS amount,
  CASE WHEN k % 14 = 0 THEN DATE '2026-05-05' ELSE due END AS due, coalesce(frequency, 'monthly') AS frequency
FROM found f JOIN (SELECT document_id, household_id, order_key AS k FROM bill_texts) b ON document_id = f.id WHERE k % 2 = 0""",
}
oracle(
    "accepted_bill_texts", "bill_texts",
    f"""SELECT document_id, 'bill-' || document_id AS bill_id, kind, provider AS provider_value,
  CASE WHEN provider IS NULL THEN 'none' ELSE 'userConfirmed' END AS provider_source,
  CASE WHEN provider IS NULL THEN 'missing' ELSE 'confirmed' END AS provider_status,
  amount AS amount_minor_value, 'userEntered' AS amount_minor_source, 'confirmed' AS amount_minor_status,
  CAST(due AS VARCHAR) AS due_date_value, 'userConfirmed' AS due_date_source, 'confirmed' AS due_date_status,
  frequency, {KIND_LABEL} || ' bill' AS title FROM joined WHERE amount IS NOT NULL AND due IS NOT NULL""",
    **_DECIDED,
)
oracle(
    "incomplete_bill_texts", "bill_texts",
    "SELECT document_id, household_id FROM joined WHERE amount IS NULL OR due IS NULL",
    **_DECIDED,
)

# ---- state changes -----------------------------------------------------------

_REQUESTS = {
    "accepted": f"""SELECT *, {_trim('resident_name')} AS resident FROM household_requests
WHERE household_id % 31 <> 0 AND household_id % 37 <> 0 AND household_id % 41 <> 0
  AND household_id % 4 <> 3 AND household_id % 5 <> 3"""
}
oracle(
    "create_households", "household_requests",
    """SELECT household_id, CASE WHEN name = '' THEN 'My Home' ELSE name END AS name, false AS onboarding_complete,
  'prop-' || household_id AS property_id, household_id || ' Mill Lane' AS line1,
  CASE WHEN household_id % 3 = 1 THEN 'Flat 1' END AS line2, 'Leeds' AS town,
  'LS1 ' || household_id % 9 || 'AB' AS postcode,
  CASE WHEN household_id % 2 = 0 THEN 'U' || household_id END AS uprn, tenure, 'Manual entry' AS address_source,
  CASE WHEN resident = '' THEN 'You' ELSE resident END AS owner_name, 'owner' AS role FROM accepted""",
    **_REQUESTS,
)
oracle(
    "create_household_slots", "household_requests",
    f"""SELECT 'svc-' || household_id || '-' || kind AS slot_id, household_id, kind, CAST(pos AS BIGINT) AS pos,
  {DEFAULT_KEYS} AS lookup_keys, 'missing' AS provider_status
FROM accepted JOIN (VALUES ('', 0, 'electricity'), ('', 1, 'gas'), ('', 2, 'water'), ('', 3, 'councilTax'),
  ('gas,water,gas', 0, 'gas'), ('gas,water,gas', 1, 'water'), ('broadband,tvLicence,other', 0, 'broadband'),
  ('broadband,tvLicence,other', 1, 'tvLicence'), ('broadband,tvLicence,other', 2, 'other'),
  ('councilTax,electricity', 0, 'councilTax'), ('councilTax,electricity', 1, 'electricity')
) AS v(services_text, pos, kind) USING (services_text)""",
    **_REQUESTS,
)
# The replay, command by command: running "last assignment" and "confirmed since" windows.
oracle(
    "slot_commands", "service_slots commands",
    """SELECT slot_id,
  CASE WHEN l.seq IS NULL THEN provider_value WHEN l.action = 'set' THEN l.value END AS provider_value,
  CASE WHEN l.seq IS NULL AND c.seq IS NOT NULL AND provider_value IS NOT NULL THEN 'userConfirmed'
    WHEN l.seq IS NULL THEN provider_source WHEN l.action = 'reject' THEN 'none'
    WHEN c.seq > l.seq THEN 'userConfirmed' ELSE 'userEntered' END AS provider_source,
  CASE WHEN l.seq IS NULL AND c.seq IS NOT NULL AND provider_value IS NOT NULL THEN 'confirmed'
    WHEN l.seq IS NULL THEN provider_status WHEN l.action = 'reject' THEN 'missing' ELSE 'confirmed' END AS provider_status,
  CASE WHEN l.action = 'reject' THEN 'rejected: ' || coalesce(
    CASE WHEN l.prior_seq IS NULL THEN provider_value WHEN l.prior_action = 'set' THEN l.prior_value END, '') END AS provider_note,
  strftime(CASE WHEN l.seq IS NULL THEN CASE WHEN provider_value IS NOT NULL THEN c.ts END
    WHEN l.action = 'set' THEN CASE WHEN c.seq > l.seq THEN c.ts ELSE l.ts END END, '%Y-%m-%d %H:%M:%S') AS provider_recorded_at
FROM service_slots s
LEFT JOIN (SELECT * FROM assigned QUALIFY row_number() OVER (PARTITION BY household_id, kind ORDER BY seq DESC) = 1) l
  ON l.household_id = s.household_id AND l.kind = s.kind
LEFT JOIN (SELECT household_id, kind, max(seq) AS seq, arg_max(ts, seq) AS ts FROM commands WHERE action = 'confirm' GROUP BY ALL) c
  ON c.household_id = s.household_id AND c.kind = s.kind""",
    assigned="""SELECT household_id, kind, seq, ts, action, trim(value) AS value,
  lag(seq) OVER w AS prior_seq, lag(action) OVER w AS prior_action, lag(trim(value)) OVER w AS prior_value
FROM commands WHERE action IN ('set', 'reject') WINDOW w AS (PARTITION BY household_id, kind ORDER BY seq)""",
)


def _stamped(**times: str) -> str:
    """When fields were recorded, as text, from a condition and a time each."""
    return ", ".join(f"strftime({time}, '%Y-%m-%d %H:%M:%S') AS {name}_recorded_at" for name, time in times.items())


def _entered(name: str, new: str, value: str) -> str:
    """A field overwritten by the resident where ``new`` holds."""
    return (
        f"CASE WHEN {new} THEN {value} ELSE {name}_value END AS {name}_value, "
        f"CASE WHEN {new} THEN CASE WHEN {value} IS NULL THEN 'none' ELSE 'userEntered' END ELSE {name}_source END AS {name}_source, "
        f"CASE WHEN {new} THEN CASE WHEN {value} IS NULL THEN 'missing' ELSE 'confirmed' END ELSE {name}_status END AS {name}_status"
    )


oracle(
    "slot_edits", "service_slots commands",
    f"""SELECT slot_id, {_entered('account_number', 'account IS NOT NULL', "nullif(trim(account), '')")},
  {_entered('amount_minor', 'amount IS NOT NULL', 'amount')},
  {_entered('next_due_date', 'due IS NOT NULL', 'CAST(try_cast(due AS DATE) AS VARCHAR)').replace('ELSE next_due_date_value', 'ELSE CAST(next_due_date_value AS VARCHAR)')},
  coalesce(e.frequency, s.frequency) AS frequency, {_stamped(
    account_number="CASE WHEN trim(account) <> '' THEN account_at END", amount_minor='amount_at',
    next_due_date='CASE WHEN try_cast(due AS DATE) IS NOT NULL THEN due_at END')}
FROM service_slots s LEFT JOIN edits e ON e.household_id = s.household_id AND e.kind = s.kind""",
    edits="""SELECT household_id, kind, arg_max(account, seq) FILTER (account IS NOT NULL) AS account,
  arg_max(amount, seq) FILTER (amount > 0) AS amount,
  arg_max('quarterly', seq) FILTER (seq % 5 = 0) AS frequency,
  arg_max(due, seq) FILTER (due IS NOT NULL) AS due, arg_max(ts, seq) FILTER (account IS NOT NULL) AS account_at,
  arg_max(ts, seq) FILTER (amount > 0) AS amount_at, arg_max(ts, seq) FILTER (due IS NOT NULL) AS due_at
FROM (SELECT household_id, kind, seq, ts,
  CASE WHEN seq % 4 = 0 THEN ' N' || seq WHEN seq % 12 = 1 THEN ' ' END AS account,
  CASE WHEN seq % 3 = 0 THEN minor - 1000 END AS amount,
  CASE WHEN seq % 7 = 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN seq % 7 = 1 THEN 'soon' END AS due FROM commands)
GROUP BY household_id, kind""",
)
oracle(
    "partial_slot_edits", "service_slots commands",
    f"""SELECT slot_id, {_entered('provider', 'p IS NOT NULL', "'P' || p")},
  {_entered('account_number', 'n IS NOT NULL', "'N' || n")},
  {_entered('amount_minor', 'a IS NOT NULL', 'a * 100')},
  {_entered('next_due_date', 'due IS NOT NULL', 'CAST(due AS VARCHAR)').replace('ELSE next_due_date_value', 'ELSE CAST(next_due_date_value AS VARCHAR)')},
  CASE WHEN a IS NOT NULL THEN 'weekly' ELSE frequency END AS frequency,
  {_stamped(provider='p_at', account_number='n_at', amount_minor='a_at', next_due_date='due_at')}
FROM service_slots s LEFT JOIN edits e ON e.household_id = s.household_id AND e.kind = s.kind""",
    edits="""SELECT household_id, kind, max(seq) FILTER (seq % 3 = 0) AS p, max(seq) FILTER (seq % 4 = 0) AS n,
  max(seq) FILTER (seq % 5 = 1) AS a, arg_max(CAST(ts AS DATE), seq) FILTER (seq % 7 = 0) AS due,
  arg_max(ts, seq) FILTER (seq % 3 = 0) AS p_at, arg_max(ts, seq) FILTER (seq % 4 = 0) AS n_at,
  arg_max(ts, seq) FILTER (seq % 5 = 1) AS a_at, arg_max(ts, seq) FILTER (seq % 7 = 0) AS due_at
FROM commands GROUP BY household_id, kind""",
)
oracle(
    "slot_membership", "households service_slots commands",
    f"""SELECT slot_id, household_id, kind, provider_value, lookup_keys_text AS lookup_keys FROM service_slots s
WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.household_id = s.household_id AND l.kind = s.kind AND removed IS NOT NULL)
UNION ALL SELECT 'svc-' || household_id || '-' || kind, household_id, kind, NULL, {DEFAULT_KEYS} FROM last l
WHERE coalesce(added > removed, added IS NOT NULL) AND (removed IS NOT NULL OR NOT EXISTS (
  SELECT 1 FROM service_slots s WHERE l.household_id = s.household_id AND l.kind = s.kind))""",
    changes="SELECT household_id, ["
    + ", ".join(f"'{k}'" for k in SERVICE_KINDS)
    + "][seq % 9 + 1] AS kind, seq, action = 'reject' AS gone FROM commands "
    "WHERE household_id IN (SELECT household_id FROM households)",
    last="""SELECT household_id, kind, max(seq) FILTER (NOT gone) AS added, max(seq) FILTER (gone) AS removed
FROM changes GROUP BY household_id, kind""",
)
def _synced(newest: str, tables: str, **extra: str) -> str:
    """Slots overwritten by the newest values ``p, a, f, d`` of their kind."""
    return _with(tables, f"SELECT {_synced_columns('p IS NOT NULL', 'a IS NOT NULL')} {_SYNCED}", **extra, newest=newest)


_SYNCED = "FROM service_slots s LEFT JOIN newest n ON n.household_id = s.household_id AND n.kind = s.kind"


def _synced_columns(new_provider: str, new_amount: str) -> str:
    due = _entered("next_due_date", "d IS NOT NULL", "CAST(d AS VARCHAR)")
    due = due.replace("ELSE next_due_date_value", "ELSE CAST(next_due_date_value AS VARCHAR)")
    return f"""slot_id, {_entered('provider', new_provider, 'p')}, {_entered('amount_minor', new_amount, 'a')},
  {due}, CASE WHEN {new_amount} THEN f ELSE s.frequency END AS frequency"""


_SINCE = "s.household_id % 3 = 0 AND {} < TIMESTAMP '1997-01-01'"
_NEW_P, _NEW_A = (f"(n.kind IS NOT NULL AND {x} IS NOT NULL AND NOT ({_SINCE.format(x + '_at')}))" for x in "pa")
_BEFORE = "WHEN s.household_id % 3 = 0 THEN TIMESTAMP '1997-01-01' END"
oracle(
    "slot_sync_from_bills", "service_slots bills",
    f"""SELECT {_synced_columns(_NEW_P, _NEW_A)}, {_stamped(
      provider=f'CASE WHEN {_NEW_P} THEN p_at {_BEFORE}', amount_minor=f'CASE WHEN {_NEW_A} THEN a_at {_BEFORE}',
      next_due_date='d_at')} {_SYNCED}""",
    newest=f"""SELECT household_id, kind,
  max(updated_at) FILTER (provider_value IS NOT NULL) AS p_at, max(updated_at) AS a_at,
  max(updated_at) FILTER (due_date_value IS NOT NULL) AS d_at,
  first(provider_value ORDER BY updated_at DESC, bill_id DESC) FILTER (provider_value IS NOT NULL) AS p,
  first(amount_minor_value ORDER BY updated_at DESC, bill_id DESC) AS a,
  first(frequency ORDER BY updated_at DESC, bill_id DESC) AS f,
  first(due_date_value ORDER BY updated_at DESC, bill_id DESC) FILTER (due_date_value IS NOT NULL) AS d
FROM bills WHERE {SURE} AND NOT {EST} GROUP BY household_id, kind""",
)
ORACLES["accepted_slot_updates"] = _synced(
    """SELECT household_id, kind, first(provider ORDER BY document_id DESC) FILTER (provider IS NOT NULL) AS p,
  first(amount ORDER BY document_id DESC) AS a, first(frequency ORDER BY document_id DESC) AS f,
  first(due ORDER BY document_id DESC) AS d
FROM joined WHERE amount IS NOT NULL AND due IS NOT NULL GROUP BY household_id, kind""",
    "service_slots bill_texts",
    **_DECIDED,
)
oracle(
    "bill_commands", "bills",
    f"""SELECT bill_id, household_id, {_entered('amount_minor', 'a IS NOT NULL', 'a')},
  {_entered('due_date', 'd IS NOT NULL', 'CAST(d AS VARCHAR)').replace('ELSE due_date_value', 'ELSE CAST(due_date_value AS VARCHAR)')},
  CASE WHEN paid_seq IS NULL THEN payment_status WHEN paid_seq % 2 = 0 THEN 'paid' ELSE 'unknown' END AS payment_status,
  CASE WHEN note_seq % 15 = 1 THEN NULL WHEN note_seq IS NOT NULL THEN 'note ' || note_seq ELSE notes END AS notes
FROM rows_now LEFT JOIN patches USING (bill_id)
WHERE bill_id NOT IN (SELECT bill_id FROM aimed WHERE event_id % 5 = 3 AND event_id % 2 = 0)""",
    aimed="SELECT *, 'b-' || ((event_id - event_id % 10) * 3 // 2 + event_id % 3) AS bill_id FROM events",
    inserted="""SELECT * REPLACE (CASE WHEN event_id % 30 = 4 THEN bill_id ELSE 'n-' || (event_id - event_id % 10) END AS bill_id)
FROM aimed WHERE event_id % 5 IN (2, 4)""",
    rows_now="""SELECT bill_id, household_id, amount_minor_value, amount_minor_source, amount_minor_status,
  due_date_value, due_date_source, due_date_status, payment_status, notes FROM bills
UNION ALL SELECT bill_id, user_id, CAST(round(value * 100) AS BIGINT), 'userEntered', 'confirmed',
  NULL, 'none', 'missing', 'unknown', NULL FROM inserted i WHERE NOT EXISTS (SELECT 1 FROM bills b WHERE b.bill_id = i.bill_id)
QUALIFY row_number() OVER (PARTITION BY bill_id ORDER BY event_id DESC) = 1""",
    patches="""SELECT bill_id,
  max(event_id) FILTER (event_id % 5 = 0 OR (event_id % 5 = 3 AND event_id % 2 = 1)) AS paid_seq,
  max(event_id) FILTER (event_id % 5 = 1) AS note_seq,
  arg_max(CAST(round(value * 100) AS BIGINT), event_id) FILTER (event_id % 5 = 1 AND round(value * 100) > 0) AS a,
  arg_max(CAST(ts AS DATE), event_id) FILTER (event_id % 5 = 1 AND event_id % 3 = 0) AS d
FROM aimed GROUP BY 1""",
)
oracle(
    "reminders_from_bills", "bills",
    f"""SELECT 'rem-' || bill_id AS reminder_id, household_id, 'payment' AS kind, {KIND_LABEL} || ' payment' AS title,
  CAST(greatest(due_date_value - 3, {_D}) AS VARCHAR) AS due_at, 'from_bill_due_date' AS note, bill_id, false AS is_done
FROM bills WHERE NOT {PAID} AND due_date_value IS NOT NULL""",
)
oracle(
    "reminder_commands", "reminders",
    """SELECT reminder_id, household_id, coalesce(t, title) AS title, CAST(coalesce(d, due_at) AS VARCHAR) AS due_at,
  coalesce(o, is_done) AS is_done
FROM reminders LEFT JOIN patches USING (reminder_id)
WHERE reminder_id NOT IN (SELECT 'r-' || (event_id - event_id % 4) FROM events WHERE event_id % 40 = 2)
UNION ALL SELECT 'new-' || event_id, user_id, 'Added', CAST(CAST(ts AS DATE) AS VARCHAR), false
FROM events WHERE event_id % 4 = 1""",
    patches="""SELECT 'r-' || (event_id - event_id % 4) AS reminder_id,
  arg_max(CASE WHEN event_id % 4 = 0 THEN 'T' ELSE 'U' END || event_id, event_id) FILTER (event_id % 8 = 0 OR event_id % 4 = 2) AS t,
  arg_max(CAST(ts AS DATE), event_id) FILTER (event_id % 12 = 0 OR event_id % 4 = 3) AS d,
  arg_max(CASE WHEN event_id % 4 = 0 THEN event_id % 16 = 0 ELSE event_id % 3 = 0 END, event_id) FILTER (event_id % 4 IN (0, 3)) AS o
FROM events WHERE event_id % 4 <> 1 AND event_id % 40 <> 2 GROUP BY 1""",
)
oracle(
    "document_commands", "bill_texts documents_ledger",
    f"""SELECT household_id, 'read-' || document_id AS document_id, {KIND_LABEL} || ' bill' AS title,
  'captured_from_bill_text' AS notes, '2026-01-02' AS created
FROM joined WHERE amount IS NOT NULL AND due IS NOT NULL
UNION ALL SELECT household_id, document_id, title, notes, strftime(created_at, '%Y-%m-%d') FROM documents_ledger
WHERE CAST(substr(document_id, 5) AS BIGINT) % 4 <> 0""",
    **_DECIDED,
)
_MEMBERS = {
    "left_members": """SELECT member_id, household_id, name,
  CASE WHEN pos = 1 AND household_id % 3 = 0 THEN 'housemate' ELSE role END AS role, has_accepted_invite, pos
FROM members WHERE NOT (pos = 0 AND household_id % 5 = 0)
UNION ALL SELECT 'i-' || c_custkey, c_custkey, c_name, 'viewer', false, 2 + c_custkey FROM customer WHERE c_custkey % 4 = 0"""
}
oracle("member_commands", "members", "SELECT * FROM left_members", **_MEMBERS)
oracle(
    "member_choices", "households members",
    """SELECT household_id, member_id AS current_member_id FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.household_id ORDER BY member_id <> CASE
    WHEN h.household_id % 8 = 0 THEN 'i-' || h.household_id ELSE current_member_id END, pos) AS rn
  FROM households h JOIN left_members m ON m.household_id = h.household_id) WHERE rn = 1""",
    **_MEMBERS,
)
oracle(
    "property_commands", "properties",
    """SELECT property_id, CASE WHEN moved THEN household_id || ' New Road' ELSE line1 END AS line1,
  CASE WHEN NOT moved THEN line2 END AS line2, CASE WHEN moved THEN 'York' ELSE town END AS town,
  CASE WHEN moved THEN 'YO1 7HH' ELSE postcode END AS postcode, CASE WHEN NOT moved THEN uprn END AS uprn,
  CASE WHEN household_id % 4 = 0 THEN 'other' WHEN moved THEN 'owning' ELSE tenure END AS tenure, is_demo_data
FROM (SELECT *, household_id % 6 = 0 AS moved FROM properties)""",
)
oracle(
    "onboarding_commands", "households",
    """SELECT household_id, onboarding_complete OR (household_id % 2 = 0 AND household_id % 20 <> 0) AS onboarding_complete
FROM households""",
)
oracle(
    "household_reset", "households properties service_slots bills documents_ledger reminders members",
    "\nUNION ALL ".join(
        f"SELECT household_id, '{name}' AS table_name, count(*) AS row_count FROM {table} "
        f"WHERE household_id NOT IN (SELECT household_id FROM households WHERE household_id % 5 = 0) GROUP BY household_id"
        for name, table in {
            "households": "households", "properties": "properties", "service_slots": "service_slots",
            "bills": "bills", "documents": "documents_ledger", "reminders": "reminders", "members": "members",
        }.items()
    ),
)

# ---- validation --------------------------------------------------------------

_K_BILL = "CAST(substr(bill_id, 3) AS BIGINT)"
oracle(
    "validate_households", "household_requests",
    """SELECT * FROM (SELECT household_id, concat_ws(',',
  CASE WHEN household_id % 31 = 0 THEN 'line1_required' END, CASE WHEN household_id % 37 = 0 THEN 'town_required' END,
  CASE WHEN household_id % 41 = 0 THEN 'postcode_required' END, CASE WHEN household_id % 4 = 3 THEN 'unknown_tenure' END,
  CASE WHEN household_id % 5 = 3 THEN 'unknown_service' END) AS codes FROM household_requests) WHERE codes <> ''""",
)
oracle(
    "validate_bills", "bills",
    f"""SELECT * FROM (SELECT bill_id, concat_ws(',', CASE WHEN {_K_BILL} % 13 = 0 THEN 'unknown_kind' END,
  CASE WHEN amount_minor_value IS NULL THEN 'amount_required' WHEN {_K_BILL} % 9 = 0 THEN 'amount_not_positive' END) AS codes
  FROM bills) WHERE codes <> ''""",
)
oracle(
    "validate_bill_updates", "commands",
    """SELECT seq, concat_ws(',', CASE WHEN seq % 3 = 1 THEN 'unknown_payment_status' END,
  CASE WHEN seq % 4 = 1 OR (seq % 4 = 0 AND minor - 5000 <= 0) THEN 'amount_not_positive' END) AS codes FROM commands""",
)
oracle(
    "validate_slot_updates", "commands service_slots",
    """SELECT seq, concat_ws(',', CASE WHEN seq % 11 = 0 THEN 'unknown_action' END,
  CASE WHEN seq % 11 <> 0 AND action = 'confirm' AND provider_value IS NULL THEN 'nothing_to_confirm' END,
  CASE WHEN seq % 11 <> 0 AND action = 'set' AND seq % 4 = 0 THEN 'provider_required' END,
  CASE WHEN seq % 5 = 0 OR (seq % 5 = 1 AND minor - 5000 <= 0) THEN 'amount_not_positive' END) AS codes
FROM commands c LEFT JOIN service_slots s ON s.household_id = c.household_id AND s.kind = c.kind""",
)
oracle(
    "validate_reminders", "reminders",
    """SELECT reminder_id,
  concat_ws(',', CASE WHEN k % 5 <= 1 THEN 'title_required' END, CASE WHEN k % 7 <= 2 THEN 'date_required' END) AS codes,
  concat_ws(',', CASE WHEN k % 5 = 0 THEN 'title_required' END, CASE WHEN k % 7 <= 1 THEN 'date_required' END) AS update_codes
FROM (SELECT reminder_id, CAST(substr(reminder_id, 3) AS BIGINT) AS k FROM reminders)""",
)
oracle(
    "validate_documents", "documents_ledger",
    """SELECT document_id, 'title_required' AS codes FROM documents_ledger
WHERE CAST(substr(document_id, 5) AS BIGINT) % 10 = 9""",
)
oracle(
    "validate_slots", "service_slots",
    """SELECT slot_id, 'provider:value_without_status' AS codes FROM service_slots
WHERE household_id % 3 = 0 AND provider_value IS NOT NULL""",
)
oracle(
    "duplicate_slots", "service_slots",
    """SELECT household_id, kind, count(*) AS slot_count FROM (SELECT * FROM service_slots
  UNION ALL SELECT * FROM service_slots WHERE household_id % 4 = 0) GROUP BY household_id, kind HAVING count(*) > 1""",
)
oracle("orphan_rows", "bills", "SELECT bill_id, household_id FROM bills WHERE household_id % 20 = 0")
oracle(
    "command_permissions", "commands members",
    """SELECT seq, CASE WHEN seq % 6 = 0 AND coalesce(role, '') <> 'owner' THEN 'may_not_manage'
  WHEN seq % 18 = 3 THEN 'unknown_action' WHEN seq % 6 = 2 THEN ''
  WHEN seq % 6 <> 0 AND (seq % 6 = 1 OR action <> 'not_sure') AND coalesce(role, 'viewer') = 'viewer' THEN 'may_not_edit_bills'
  ELSE '' END AS codes
FROM commands c LEFT JOIN members m ON m.household_id = c.household_id AND m.member_id = c.member_id""",
)
oracle(
    "bill_form_checks", "bills",
    """SELECT bill_id, CASE WHEN household_id % 2 = 0 AND due_date_value IS NULL THEN 'date_required' ELSE '' END AS form_codes,
  concat_ws(',', CASE WHEN amount_minor_value IS NULL THEN 'amount_required' END,
    CASE WHEN due_date_value IS NULL THEN 'date_required' END) AS codes FROM bills""",
)
oracle(
    "unknown_enum_warnings", "bills",
    f"SELECT bill_id, CASE WHEN {_K_BILL} % 5 = 0 THEN 'unknown_frequency' ELSE '' END AS codes FROM bills",
)

# ---- sources -----------------------------------------------------------------


def _flat(*names: str) -> str:
    out = []
    for name in names:
        value = f"{name}_value" if not name.endswith("date") else f"CAST({name}_value AS VARCHAR) AS {name}_value"
        out.append(f"{value}, {name}_source, {name}_status")
    return ", ".join(out)


_STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
# The property that a written item names: that of its household.
_HOMES = "(SELECT household_id, min(property_id) AS property_id FROM properties GROUP BY household_id) homes"
oracle(
    "json_bills_roundtrip", "bills properties",
    f"""SELECT bill_id, household_id, kind, {_flat('provider', 'amount_minor', 'due_date')},
  CAST(period_start AS VARCHAR) AS period_start, frequency, payment_status, document_id, {_STAMP}, property_id
FROM bills LEFT JOIN {_HOMES} USING (household_id)""",
)
oracle(
    "json_slots_roundtrip", "service_slots properties",
    f"""SELECT slot_id, household_id, kind, {_flat('provider', 'account_number', 'amount_minor', 'next_due_date')},
  frequency, lookup_keys_text AS lookup_keys, property_id
FROM service_slots LEFT JOIN {_HOMES} USING (household_id)""",
)
oracle(
    "json_households_roundtrip", "households properties service_slots bills documents_ledger reminders members",
    """SELECT household_id, h.name, coalesce(h.property_id, p.property_id) AS property_id, h.current_member_id,
  coalesce(h.onboarding_complete, false) AS onboarding_complete, coalesce(is_demo_data, false) AS document_is_demo_data,
  line1, nullif(line2, '') AS line2, town, postcode, uprn, tenure, is_demo_data
FROM households h FULL JOIN properties p USING (household_id)
FULL JOIN (SELECT household_id FROM service_slots UNION SELECT household_id FROM bills UNION SELECT household_id FROM documents_ledger
  UNION SELECT household_id FROM reminders UNION SELECT household_id FROM members) s USING (household_id)""",
)
oracle(
    "json_members_roundtrip", "members",
    "SELECT member_id, household_id, name, role, has_accepted_invite, is_current_user, pos FROM members",
)
oracle(
    "json_reminders_roundtrip", "reminders properties",
    f"SELECT * REPLACE (CAST(due_at AS VARCHAR) AS due_at) FROM reminders LEFT JOIN {_HOMES} USING (household_id)",
)
oracle(
    "json_documents_roundtrip", "documents_ledger properties",
    f"""SELECT document_id, household_id, kind, title, provider_name, content_type, byte_size, extracted_text, bill_id, {_STAMP},
  property_id FROM documents_ledger LEFT JOIN {_HOMES} USING (household_id)""",
)
# What each damaged document is meant to be: k is the event id.
_MESSY = {
    "messy": """SELECT event_id AS k, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CASE WHEN event_id % 31 = 0 THEN 'not_json' WHEN event_id % 37 = 0 THEN 'not_an_object'
    WHEN event_id % 29 = 0 THEN 'unknown_version' WHEN event_id % 41 = 0 THEN 'no_household_id' END AS reason FROM events""",
    "good": "SELECT * FROM messy WHERE reason IS NULL AND k % 7 <> 0",
}
oracle(
    "json_tolerant_decode", "",
    """SELECT k AS household_id, 'x-' || k AS bill_id, CASE WHEN k % 3 = 0 THEN 'gas' ELSE 'other' END AS kind,
  CASE WHEN k % 4 <> 2 THEN k END AS amount_minor_value,
  CASE WHEN k % 5 = 0 THEN 'none' ELSE 'userEntered' END AS amount_minor_source,
  CASE WHEN k % 4 = 2 THEN 'missing' WHEN k % 2 = 0 THEN 'confirmed' ELSE 'suggested' END AS amount_minor_status,
  CASE WHEN k % 6 <> 0 THEN day END AS due_date_value, 'none' AS due_date_source,
  CASE WHEN k % 6 <> 0 THEN 'confirmed' ELSE 'missing' END AS due_date_status,
  'monthly' AS frequency, 'unknown' AS payment_status FROM good""",
    **_MESSY,
)
oracle(
    "json_quarantine", "",
    "SELECT reason, count(*) AS document_count FROM messy WHERE reason IS NOT NULL GROUP BY reason",
    messy=_MESSY["messy"],
)
oracle(
    "json_unreadable_values", "",
    "SELECT k AS household_id, 'x-' || k AS bill_id, 'amountMinor' AS unreadable FROM good WHERE k % 4 = 2",
    **_MESSY,
)


_ITEMS = {
    "known": """SELECT coalesce(h.household_id, p.household_id) AS household_id, h.name, p.postcode
FROM households h FULL JOIN properties p ON p.household_id = h.household_id""",
    "entries": """SELECT household_id, 'services' AS list, slot_id AS id, kind, CAST(amount_minor_value AS VARCHAR) AS value,
  amount_minor_status AS status, provider_value AS label FROM service_slots
UNION ALL SELECT household_id, 'bills', bill_id, kind, CAST(amount_minor_value AS VARCHAR), amount_minor_status, provider_value FROM bills
UNION ALL SELECT household_id, 'documents', document_id, kind, title, bill_id, provider_name FROM documents_ledger
UNION ALL SELECT household_id, 'reminders', reminder_id, kind, title, CAST(is_done AS VARCHAR), CAST(due_at AS VARCHAR) FROM reminders
UNION ALL SELECT household_id, 'members', member_id, role, name, CAST(has_accepted_invite AS VARCHAR), CAST(is_current_user AS VARCHAR) FROM members""",
    "heads": """SELECT household_id, name, postcode FROM known
UNION ALL SELECT DISTINCT household_id, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM entries
WHERE household_id NOT IN (SELECT household_id FROM known)""",
}
_ITEM_TABLES = "households properties service_slots bills documents_ledger reminders members"
oracle(
    "household_payloads", _ITEM_TABLES,
    """SELECT household_id, 'head' AS list, name AS id, postcode AS kind, CAST(NULL AS VARCHAR) AS value,
  CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS label, false AS shows_text FROM heads
UNION ALL SELECT household_id, list, id, kind, value, status, label, false FROM entries""",
    **_ITEMS,
)
oracle(
    "payload_pieces", _ITEM_TABLES,
    """SELECT household_id, 6 + count(list) AS piece_count, count(list) - count(DISTINCT list) AS comma_count, 6 AS frame_count,
  ']}' AS last_piece, count(DISTINCT list) AS filled_lists
FROM heads LEFT JOIN entries USING (household_id) GROUP BY household_id""",
    **_ITEMS,
)
oracle(
    "relational_fields", "bills",
    f"SELECT bill_id, {_flat('provider', 'amount_minor', 'due_date')} FROM bills",
)
_DAMAGED = {"n": "SELECT *, CAST(substr(bill_id, 3) AS BIGINT) % 16 AS m FROM bills"}
oracle(
    "relational_damaged_fields", "bills",
    f"""SELECT bill_id, CASE WHEN m IN (3, 5, 9, 13) THEN NULL WHEN m = 7 THEN 12 WHEN m = 11 THEN 7 ELSE amount_minor_value END AS amount_minor_value,
  CASE WHEN m IN (3, 5, 9, 11, 13) THEN 'none' WHEN m = 7 THEN 'userEntered' ELSE amount_minor_source END AS amount_minor_source,
  CASE WHEN m IN (3, 5, 9, 13) THEN 'missing' WHEN m IN (7, 11) THEN 'confirmed' ELSE amount_minor_status END AS amount_minor_status,
  {_flat('due_date')} FROM n""",
    **_DAMAGED,
)
oracle(
    "relational_unreadable", "bills",
    """SELECT bill_id, 'amount_minor' AS field, CASE m WHEN 9 THEN 'unreadable_value,unknown_source,unknown_status'
  WHEN 11 THEN 'unknown_source,unreadable_time' ELSE 'not_an_object' END AS codes,
  CASE m WHEN 3 THEN 'oops' WHEN 5 THEN '[1]' WHEN 9 THEN '{"value":"lots","source":"rumour","status":"sure"}'
  WHEN 11 THEN '{"value":7,"source":"rumour","status":"confirmed","recordedAt":"yesterday"}' ELSE '{"value":1}}' END AS text
FROM n WHERE m IN (3, 5, 9, 11, 13)""",
    **_DAMAGED,
)
oracle(
    "document_listing", "documents_ledger",
    """SELECT household_id, document_id, title, strftime(created_at, '%Y-%m-%d') AS created, false AS has_text
FROM documents_ledger""",
)
oracle(
    "address_feed", "",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_custkey || ' Mill Lane' ELSE 'Address' END AS line1,
  CAST(NULL AS VARCHAR) AS line2, CASE c_custkey % 4 WHEN 0 THEN 'Leeds' WHEN 1 THEN '' ELSE 'York' END AS town,
  CASE c_custkey % 4 WHEN 0 THEN 'LS1 2AB' ELSE 'LS9 9ZZ' END AS postcode,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) END AS uprn FROM customer WHERE c_custkey % 4 <> 2""",
)
oracle(
    "address_feed_damaged", "",
    """SELECT c_custkey, 'Address' AS line1, CAST(NULL AS VARCHAR) AS line2, CASE WHEN c_custkey % 13 = 6 THEN 'Hull' ELSE '' END AS town,
  'LS9 9ZZ' AS postcode, CASE WHEN c_custkey % 13 = 6 THEN '9' ELSE CAST(c_custkey AS VARCHAR) END AS uprn
FROM customer WHERE c_custkey % 13 NOT IN (1, 2, 3, 4, 5, 7)""",
)
oracle(
    "address_feed_quarantine", "",
    """SELECT c_custkey, CAST(position AS BIGINT) AS position, reason, json FROM customer JOIN (VALUES
  (1, NULL, 'not_json', 'oops'), (2, NULL, 'not_an_object', '[1]'), (3, NULL, 'results_not_a_list', '{"results":"none"}'),
  (4, NULL, 'no_results', '{}'), (6, 0, 'not_an_object', 'text'), (6, 1, 'not_an_object', '7'),
  (6, 2, 'no_address', '{"LPI":{"UPRN":"1"}}'), (6, 3, 'no_address', '{"DPA":[]}'),
  (7, NULL, 'not_json', '{"results":[{"DPA":{"UPRN":"7"}}]}}')) AS v(place, position, reason, json) ON c_custkey % 13 = place""",
)
