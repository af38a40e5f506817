"""Ledger tables derived from the driver's Parquet tables, for queries and tests.

Each table is a list of SQL expressions over one source table, written in the
common subset of Spark SQL and DuckDB SQL, so that both engines can derive the same
rows. Fields are flat here (``x_value, x_source, x_status``); ``Ledger`` builds the
structs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "1998-06-01"
REMINDER_AS_OF = "2024-01-15"
TEXT_AS_OF = "2026-01-01"
MONTH = "1998-06-01"
SUGGESTED_AT = "2026-01-03 10:00:00"

#: Rows that one task is dealt, by source; of a customer come up to five rows, and documents hold whole texts.
ROWS_PER_TASK = {"customer": 30_000, "documents": 20_000}
DEFAULT_ROWS_PER_TASK = 100_000

KINDS9 = (
    "CASE {k} % 9 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'water' "
    "WHEN 3 THEN 'wastewater' WHEN 4 THEN 'councilTax' WHEN 5 THEN 'broadband' "
    "WHEN 6 THEN 'tvLicence' WHEN 7 THEN 'homeInsurance' ELSE 'other' END"
)
KINDS5 = (
    "CASE {k} % 5 WHEN 0 THEN 'electricity' WHEN 1 THEN 'gas' WHEN 2 THEN 'water' "
    "WHEN 3 THEN 'wastewater' ELSE 'councilTax' END"
)
FREQUENCY = (
    "CASE {k} % 6 WHEN 0 THEN 'weekly' WHEN 1 THEN 'fortnightly' WHEN 2 THEN 'monthly' "
    "WHEN 3 THEN 'quarterly' WHEN 4 THEN 'annually' ELSE 'oneOff' END"
)
MONTH_NAME = (
    "CASE {k} % 12 WHEN 0 THEN 'January' WHEN 1 THEN 'February' WHEN 2 THEN 'March' "
    "WHEN 3 THEN 'April' WHEN 4 THEN 'May' WHEN 5 THEN 'June' WHEN 6 THEN 'July' "
    "WHEN 7 THEN 'August' WHEN 8 THEN 'September' WHEN 9 THEN 'October' "
    "WHEN 10 THEN 'November' ELSE 'December' END"
)


def _s(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


@dataclass(frozen=True)
class Rule:
    source: str
    columns: dict[str, str]
    copies: int = 0  # rows per source row, numbered by column o from 0

    def sql(self) -> str:
        """The table as a DuckDB query."""
        source = self.source
        if self.copies:
            source = f"(SELECT *, unnest(range({self.copies})) AS o FROM {source})"
        columns = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {columns} FROM {source}"

    def frame(self, source: DataFrame) -> DataFrame:
        """The table as a Spark DataFrame."""
        if self.copies:
            source = source.selectExpr("*", f"explode(sequence(0L, {self.copies - 1}L)) AS o")
        columns = [f"{expr} AS {name}" for name, expr in self.columns.items()]
        return source.selectExpr(*columns)


_C, _O, _E = "c_custkey", "o_orderkey", "event_id"
_SLOT_AMOUNT = "CAST(round(abs(c_acctbal) * 100) AS BIGINT) + o"
_SLOT_HAS_AMOUNT = "(c_custkey + 3 * o) % 4"
_PRICE = "CAST(round(o_totalprice * 100) AS BIGINT)"
_DAY = f"lpad({_s('o_orderkey % 28 + 1')}, 2, '0')"
_MON = f"lpad({_s('o_orderkey % 12 + 1')}, 2, '0')"
_NL = "chr(10)"
_TEXT = f" || {_NL} || ".join(
    [
        "CASE o_orderkey % 5 WHEN 0 THEN 'Octopus Energy Ltd' WHEN 1 THEN 'THAMES WATER' "
        "WHEN 2 THEN 'Provider: Lumen' WHEN 3 THEN 'Bristol City Council' ELSE 'Your statement' END",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'Balance brought forward: £99999.00' ELSE 'Usage £1.00' END",
        "CASE o_orderkey % 6 WHEN 0 THEN '' "
        f"WHEN 1 THEN 'Charge £' || {_s('CAST(o_totalprice AS DECIMAL(12,2))')} "
        f"WHEN 2 THEN 'Total amount due: £' || {_s('CAST(o_totalprice AS DECIMAL(12,2))')} "
        f"WHEN 3 THEN '  Amount due: £ ' || {_s('o_orderkey % 9 + 1')} || ',' || "
        f"lpad({_s('o_orderkey % 1000')}, 3, '0') || '.50 (VAT £3.10)  ' "
        f"WHEN 4 THEN 'Please pay £' || {_s('CAST(o_totalprice AS DECIMAL(12,2))')} || ' now' "
        f"ELSE 'New balance: £' || {_s('o_orderkey % 900')} || '. Total: £7' END",
        "CASE o_orderkey % 7 "
        f"WHEN 0 THEN 'Payment due date: ' || {_DAY} || '/' || {_MON} || '/2026' "
        f"WHEN 1 THEN 'Due on ' || {_DAY} || '-' || {_MON} || '-' || lpad({_s('o_orderkey % 60')}, 2, '0') "
        f"WHEN 2 THEN 'Pay by ' || {_s('o_orderkey % 28 + 1')} || 'th of ' || "
        f"substr({MONTH_NAME.format(k=_O)}, 1, 3) || ' 2026' "
        f"WHEN 3 THEN 'Due ' || {MONTH_NAME.format(k=_O)} || ' ' || {_s('o_orderkey % 28 + 1')} || ', 2026' "
        f"WHEN 4 THEN 'Due date: 2026-' || {_MON} || '-' || {_DAY} "
        "WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Payment due: 31/02/2026' "
        "ELSE 'Instalment due: 31.12.2026' END "
        "ELSE 'No date printed' END",
        "CASE o_orderkey % 11 WHEN 0 THEN 'Monthly direct debit' WHEN 1 THEN 'Quarterly' "
        "WHEN 2 THEN 'per year' WHEN 3 THEN 'fortnightly' WHEN 4 THEN 'Weekly payment' ELSE '' END",
        "CASE o_orderkey % 13 WHEN 0 THEN 'Your electricity bill' WHEN 1 THEN 'MPRN 1234567' "
        "WHEN 2 THEN 'Sewerage charges' WHEN 3 THEN 'Broadband and fibre' "
        "WHEN 4 THEN 'TV licence renewal' WHEN 5 THEN 'Home insurance policy' "
        "WHEN 6 THEN 'Council tax instalment' ELSE '' END",
    ]
)
# Eight neighbouring customers share one postcode.


def _digit(divisor: int, modulus: int) -> str:
    """(customer group // divisor) % modulus without an integer-division operator."""
    step = 8 * divisor
    return f"CAST(((c_custkey - c_custkey % {step}) / {step}) % {modulus} AS BIGINT)"


_POSTCODE = (
    f"CASE {_digit(1, 5)} WHEN 0 THEN 'BS' WHEN 1 THEN 'CF' WHEN 2 THEN 'LS' WHEN 3 THEN 'M' "
    f"ELSE 'SW' END || {_s(_digit(5, 90) + ' + 1')} || ' ' || {_s(_digit(450, 10))} || "
    f"chr(CAST(65 + {_digit(4500, 26)} AS INT)) || chr(CAST(65 + {_digit(117000, 26)} AS INT))"
)


def _unowned(every: int) -> str:
    """The customer as household; every so many rows belong to one that does not exist."""
    return f"CASE WHEN {_C} % {every} = 0 THEN -1 - {_C} ELSE {_C} END"


RULES: dict[str, Rule] = {
    "households": Rule(
        "customer",
        {
            "household_id": _C,
            "name": "c_name",
            "property_id": f"CASE WHEN {_C} % 20 <> 0 THEN 'prop-' || {_s(_C)} END",
            "current_member_id": f"CASE WHEN {_C} % 7 = 0 THEN 'gone' "
            f"ELSE 'm-' || {_s(_C)} || '-' || {_s(_C + ' % 2')} END",
            "onboarding_complete": f"{_C} % 11 <> 0",
        },
    ),
    "properties": Rule(
        "customer",
        {
            "property_id": f"'prop-' || {_s(_C)}",
            "household_id": _unowned(20),
            "line1": f"{_s(_C + ' % 200 + 1')} || ' Example Street'",
            "line2": f"CASE {_C} % 3 WHEN 0 THEN 'Flat ' || {_s(_C + ' % 9')} WHEN 1 THEN '' END",
            "town": f"CASE {_C} % 8 WHEN 1 THEN 'Cardiff' WHEN 2 THEN 'Leeds' WHEN 3 THEN 'Manchester' "
            "WHEN 4 THEN 'London' WHEN 5 THEN 'Edinburgh' ELSE 'Bristol' END",
            "postcode": f"CASE {_C} % 8 WHEN 0 THEN 'bs14dj' WHEN 1 THEN 'CF10 1AA' WHEN 2 THEN 'ls1  2ab' "
            "WHEN 3 THEN 'M1 1AE' WHEN 4 THEN 'SW1A1AA' WHEN 5 THEN 'EH1 1AA' "
            "WHEN 6 THEN 'nope' ELSE 'BS1 4DJ' END",
            "uprn": f"CASE WHEN {_C} % 4 <> 0 THEN {_s(_C)} END",
            "tenure": f"CASE {_C} % 3 WHEN 0 THEN 'renting' WHEN 1 THEN 'owning' ELSE 'other' END",
            "address_source": "'Manual entry'",
            "is_demo_data": f"{_C} % 13 = 0",
        },
    ),
    "service_slots": Rule(
        "customer",
        {
            "slot_id": f"'svc-' || {_s(_C)} || '-' || {_s('o')}",
            "household_id": _unowned(25),
            "kind": KINDS5.format(k="o"),
            "provider_value": f"CASE WHEN (7 * {_C} + o) % 5 <> 0 THEN 'Supplier ' || {_s(f'({_C} + o) % 6')} END",
            "provider_source": f"CASE (7 * {_C} + o) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'postcodeLookup' "
            "WHEN 2 THEN 'billExtraction' WHEN 3 THEN 'userEntered' ELSE 'userConfirmed' END",
            "provider_status": f"CASE WHEN (7 * {_C} + o) % 5 = 0 THEN 'missing' "
            f"WHEN (7 * {_C} + o) % 5 <= 2 THEN 'suggested' ELSE 'confirmed' END",
            "account_number_value": f"CASE WHEN ({_C} + o) % 4 = 1 THEN 'A-' || {_s(_C)} || '-' || {_s('o')} END",
            "account_number_source": f"CASE WHEN ({_C} + o) % 4 = 1 THEN 'userEntered' ELSE 'none' END",
            "account_number_status": f"CASE WHEN ({_C} + o) % 4 = 1 THEN 'confirmed' ELSE 'missing' END",
            "amount_minor_value": f"CASE WHEN {_SLOT_HAS_AMOUNT} <> 0 THEN {_SLOT_AMOUNT} END",
            "amount_minor_source": f"CASE {_SLOT_HAS_AMOUNT} WHEN 0 THEN 'none' WHEN 1 THEN 'estimate' "
            "ELSE 'userEntered' END",
            "amount_minor_status": f"CASE {_SLOT_HAS_AMOUNT} WHEN 0 THEN 'missing' WHEN 2 THEN 'suggested' "
            "ELSE 'confirmed' END",
            "next_due_date_value": f"CASE WHEN ({_C} + o) % 3 <> 0 THEN DATE '1998-06-15' END",
            "next_due_date_source": f"CASE WHEN ({_C} + o) % 3 <> 0 THEN 'userEntered' ELSE 'none' END",
            "next_due_date_status": f"CASE WHEN ({_C} + o) % 3 <> 0 THEN 'confirmed' ELSE 'missing' END",
            "frequency": FREQUENCY.format(k=f"({_C} + o)"),
            "lookup_keys_text": f"CASE WHEN o = 0 THEN 'electricity_supplier' WHEN o = 1 AND {_C} % 9 = 0 "
            f"THEN 'retired_key,gas_supplier' WHEN o = 1 THEN 'gas_supplier' WHEN {_C} % 4 = 0 THEN '' "
            "WHEN o <= 3 THEN 'water_provider' ELSE 'council_tax,find_council' END",
        },
        copies=5,
    ),
    "bills": Rule(
        "orders",
        {
            "bill_id": f"'b-' || {_s(_O)}",
            "household_id": "CASE WHEN o_custkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END",
            "kind": KINDS9.format(k=_O),
            "provider_value": f"CASE WHEN {_O} % 8 <> 0 THEN 'Provider ' || {_s(_O + ' % 9')} END",
            "provider_source": f"CASE WHEN {_O} % 8 <> 0 THEN 'userEntered' ELSE 'none' END",
            "provider_status": f"CASE WHEN {_O} % 8 <> 0 THEN 'confirmed' ELSE 'missing' END",
            "amount_minor_value": f"CASE WHEN {_O} % 10 <> 0 THEN {_PRICE} END",
            "amount_minor_source": f"CASE {_O} % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'billExtraction' "
            "WHEN 2 THEN 'estimate' WHEN 3 THEN 'estimate' ELSE 'userEntered' END",
            "amount_minor_status": f"CASE {_O} % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'suggested' "
            "WHEN 2 THEN 'suggested' ELSE 'confirmed' END",
            "due_date_value": f"CASE WHEN {_O} % 7 <> 0 THEN CAST(o_orderdate AS DATE) END",
            "due_date_source": f"CASE WHEN {_O} % 7 <> 0 THEN 'userEntered' ELSE 'none' END",
            "due_date_status": f"CASE WHEN {_O} % 7 <> 0 THEN 'confirmed' ELSE 'missing' END",
            "period_start": f"CASE WHEN {_O} % 14 = 0 THEN CAST(o_orderdate AS DATE) END",
            "period_end": "CAST(NULL AS DATE)",
            "frequency": FREQUENCY.format(k=_O),
            "payment_status": "CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'scheduled' "
            "ELSE 'unknown' END",
            "document_id": f"CASE WHEN {_O} % 3 = 0 THEN 'doc-' || {_s(_O)} END",
            "notes": "CAST(NULL AS STRING)",
            "created_at": "CAST(o_orderdate AS TIMESTAMP)",
            "updated_at": "CAST(o_orderdate AS TIMESTAMP)",
        },
    ),
    "documents_ledger": Rule(
        "orders",
        {
            "document_id": f"CASE WHEN {_O} % 3 = 0 AND {_O} % 12 <> 0 THEN 'doc-' ELSE 'old-' END || {_s(_O)}",
            "household_id": "o_custkey",
            "kind": f"CASE {_O} % 4 WHEN 0 THEN 'bill' WHEN 1 THEN 'statement' WHEN 2 THEN 'receipt' ELSE 'policy' END",
            "title": f"'Document ' || {_s(_O)}",
            "provider_name": f"CASE WHEN {_O} % 8 <> 0 THEN 'Provider ' || {_s(_O + ' % 9')} END",
            "file_name": "CAST(NULL AS STRING)",
            "content_type": f"CASE WHEN {_O} % 3 <> 1 THEN 'application/pdf' END",
            "byte_size": f"CASE WHEN {_O} % 3 <> 1 THEN CAST({_O} * 10 AS BIGINT) END",
            "storage_key": "CAST(NULL AS STRING)",
            "extracted_text": f"'Text of ' || {_s(_O)}",
            "notes": "CAST(NULL AS STRING)",
            "bill_id": f"'b-' || {_s(_O)}",
            "created_at": "CAST(o_orderdate AS TIMESTAMP)",
        },
    ),
    "reminders": Rule(
        "events",
        {
            "reminder_id": f"'r-' || {_s(_E)}",
            "household_id": "user_id",
            "kind": "CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'signup' THEN 'contractRenewal' "
            "WHEN 'view' THEN 'meterReading' ELSE 'custom' END",
            "title": f"'Reminder ' || {_s(_E)}",
            "due_at": "CAST(ts AS DATE)",
            "note": "CAST(NULL AS STRING)",
            "bill_id": "CAST(NULL AS STRING)",
            "is_done": f"{_E} % 3 = 0",
        },
    ),
    "members": Rule(
        "customer",
        {
            "member_id": f"'m-' || {_s(_C)} || '-' || {_s('o')}",
            "household_id": _C,
            "name": f"'Member ' || {_s('o')}",
            "email": "CAST(NULL AS STRING)",
            "role": f"CASE WHEN o = 0 THEN 'owner' WHEN {_C} % 3 = 0 THEN 'tenant' "
            f"WHEN {_C} % 3 = 1 THEN 'housemate' ELSE 'viewer' END",
            "has_accepted_invite": "o = 0",
            "is_current_user": f"o = {_C} % 2",
            "pos": "CAST(o AS BIGINT)",
        },
        copies=2,
    ),
    "commands": Rule(
        "events",
        {
            "seq": _E,
            "household_id": "user_id",
            "member_id": f"'m-' || {_s('user_id')} || '-' || {_s(_E + ' % 3')}",
            "kind": KINDS5.format(k=_E),
            "action": "CASE event_type WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'reject' "
            "WHEN 'view' THEN 'not_sure' ELSE 'set' END",
            "value": f"CASE WHEN event_type IN ('purchase', 'signup') THEN ' Set ' || {_s(_E)} END",
            "minor": "CAST(round(value * 100) AS BIGINT)",
            "ts": "CAST(ts AS TIMESTAMP)",
        },
    ),
    "bill_texts": Rule(
        "orders",
        {
            "document_id": f"'doc-' || {_s(_O)}",
            "household_id": "o_custkey",
            "order_key": _O,
            "text": f"CASE WHEN {_O} % 101 = 0 THEN ' too short  ' WHEN {_O} % 17 = 0 "
            f"THEN replace({_TEXT}, chr(10), chr(13) || chr(10)) ELSE {_TEXT} END",
        },
    ),
    "household_requests": Rule(
        "customer",
        {
            "household_id": _C,
            "name": f"CASE WHEN {_C} % 2 = 0 THEN c_name ELSE '' END",
            "line1": f"CASE WHEN {_C} % 31 = 0 THEN '  ' ELSE {_s(_C)} || ' Mill Lane ' END",
            "line2": f"CASE WHEN {_C} % 3 = 0 THEN ' ' WHEN {_C} % 3 = 1 THEN 'Flat 1' END",
            "town": f"CASE WHEN {_C} % 37 <> 0 THEN 'Leeds' END",
            "postcode": f"CASE WHEN {_C} % 41 = 0 THEN '' ELSE 'ls1 ' || {_s(_C + ' % 9')} || 'ab' END",
            "uprn": f"CASE WHEN {_C} % 2 = 0 THEN ' U' || {_s(_C)} END",
            "tenure": f"CASE {_C} % 4 WHEN 0 THEN 'renting' WHEN 1 THEN 'owning' WHEN 2 THEN 'other' ELSE 'squatting' END",
            "services_text": f"CASE {_C} % 5 WHEN 0 THEN '' WHEN 1 THEN 'gas,water,gas' "
            "WHEN 2 THEN 'broadband,tvLicence,other' WHEN 3 THEN 'water,solar,solar,gas' "
            "ELSE 'councilTax,electricity' END",
            "resident_name": f"CASE WHEN {_C} % 3 = 0 THEN '  ' ELSE ' ' || c_name END",
        },
    ),
    "addresses": Rule(
        "customer",
        {
            "line1": f"{_s(_C + ' % 8 + 1')} || ' Example Street'",
            "town": f"'Town ' || {_s(_C + ' % 5')}",
            "postcode": f"CASE WHEN {_C} % 16 = 3 THEN 'GY1 1AA' ELSE {_POSTCODE} END",
            "uprn": f"'U' || {_s(_C)}",
        },
    ),
    # Two of six areas have several providers; in the others one is named again and again.
    "areas_by_supplier": Rule(
        "supplier",
        {
            "prefix": "CASE s_suppkey % 6 WHEN 0 THEN 'BS' WHEN 1 THEN 'CF' WHEN 2 THEN 'LS' WHEN 3 THEN 'M' WHEN 4 THEN 'SW' ELSE 'EH' END",
            "kind": "CASE o WHEN 0 THEN 'water' ELSE 'councilTax' END",
            "provider": "CASE WHEN s_suppkey % 6 + o <= 1 THEN s_name ELSE 'Regional ' || CAST(s_suppkey % 6 AS STRING) END",
            "confidence": "'areaCertain'",
            "lookup_key": "CASE o WHEN 0 THEN 'water_provider' ELSE 'council_tax' END",
        },
        copies=2,
    ),
    "address_requests": Rule(
        "customer",
        {
            "request_id": _C,
            "postcode": f"CASE WHEN {_C} % 9 = 0 THEN 'nonsense' WHEN {_C} % 10 = 1 THEN 'ZE1 0AA' "
            f"ELSE lower(replace({_POSTCODE}, ' ', '')) END",
            "uprn": f"CASE WHEN {_C} % 6 = 0 THEN 'none' ELSE 'U' || {_s(_C)} END",
        },
    ),
}


class Ledger:
    """The derived tables as DataFrames with field structs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._sources: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """All rows of a source table, those of a large one dealt out evenly.

        Parquet files are cut between row groups only, and one may hold a whole table: its scan, and
        all that is made of it before a shuffle, would be one task. Rows are dealt by their place in the file, as
        keys may repeat or be null.
        """
        if name not in self._sources:
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            shares = -(-rows.count() // ROWS_PER_TASK.get(name, DEFAULT_ROWS_PER_TASK))
            if shares > 1:
                waves = -(-shares // self.spark.sparkContext.defaultParallelism)
                rows = rows.repartition(waves * self.spark.sparkContext.defaultParallelism, F.col("_metadata.row_index"))
            self._sources[name] = rows
        return self._sources[name]

    def flat(self, name: str) -> DataFrame:
        rule = RULES[name]
        return rule.frame(self.raw(rule.source))

    def _fields(self, name: str, *fields: str) -> DataFrame:
        parts = {f"{field}_{part}" for field in fields for part in ("value", "source", "status")}
        plain = [c for c in RULES[name].columns if c not in parts]
        structs = [
            f"named_struct('value', {field}_value, 'source', {field}_source, 'status', {field}_status, "
            f"'recorded_at', CAST(NULL AS TIMESTAMP), 'note', CAST(NULL AS STRING)) AS {field}"
            for field in fields
        ]
        return self.flat(name).selectExpr(*plain, *structs)

    @cached_property
    def households(self) -> DataFrame:
        return self.flat("households")

    @cached_property
    def properties(self) -> DataFrame:
        return self.flat("properties")

    @cached_property
    def slots(self) -> DataFrame:
        table = self._fields("service_slots", "provider", "account_number", "amount_minor", "next_due_date")
        return table.selectExpr(
            "slot_id", "household_id", "kind", "provider", "account_number", "amount_minor",
            "next_due_date", "frequency",
            "filter(split(lookup_keys_text, ','), key -> key <> '') AS lookup_keys",
            "CAST(NULL AS STRING) AS note",
        )

    @cached_property
    def bills(self) -> DataFrame:
        return self._fields("bills", "provider", "amount_minor", "due_date")

    @cached_property
    def documents(self) -> DataFrame:
        return self.flat("documents_ledger")

    @cached_property
    def reminders(self) -> DataFrame:
        return self.flat("reminders")

    @cached_property
    def members(self) -> DataFrame:
        return self.flat("members")

    @cached_property
    def commands(self) -> DataFrame:
        return self.flat("commands")

    @cached_property
    def bill_texts(self) -> DataFrame:
        return self.flat("bill_texts")

    @cached_property
    def household_requests(self) -> DataFrame:
        flat = self.flat("household_requests")
        services = F.filter(F.split("services_text", ","), lambda kind: kind != "")
        return flat.withColumns(
            {
                "services": services,
                "address_source": F.lit(None).cast("string"),
                "is_demo_data": F.lit(None).cast("boolean"),
            }
        ).drop("services_text")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "households": self.households,
            "properties": self.properties,
            "service_slots": self.slots,
            "bills": self.bills,
            "documents": self.documents,
            "reminders": self.reminders,
            "members": self.members,
        }
