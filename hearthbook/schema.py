"""Names, fixed value sets and table schemas of the household ledger.

Every table is keyed by ``household_id``. Money is an integer number of pence
(``BIGINT``), calendar days are ``DATE``. A value whose origin matters is stored
as a *field*: ``struct<value, source, status, recorded_at, note>``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Enum names as they are stored in documents and tables.
# Their order is significant (kind order is a sort key).
# --------------------------------------------------------------------------
FIELD_SOURCES = (
    "none",
    "userEntered",
    "userConfirmed",
    "postcodeLookup",
    "officialLookup",
    "billExtraction",
    "estimate",
)
FIELD_STATUSES = ("missing", "suggested", "confirmed")
AUTOMATIC_SOURCES = ("postcodeLookup", "officialLookup", "billExtraction", "estimate")
HUMAN_SOURCES = ("userEntered", "userConfirmed")

SERVICE_KINDS = (
    "electricity",
    "gas",
    "water",
    "wastewater",
    "councilTax",
    "broadband",
    "tvLicence",
    "homeInsurance",
    "other",
)
KIND_LABELS = {
    "electricity": "Electricity",
    "gas": "Gas",
    "water": "Water",
    "wastewater": "Wastewater",
    "councilTax": "Council tax",
    "broadband": "Broadband",
    "tvLicence": "TV Licence",
    "homeInsurance": "Home insurance",
    "other": "Other",
}
# Used when a new household names no services.
DEFAULT_SERVICES = ("electricity", "gas", "water", "councilTax")
# Kinds that a setup list shows first, in this order; all others follow.
SETUP_ORDER = ("electricity", "gas", "water", "councilTax", "broadband")

FREQUENCIES_PER_YEAR = {
    "weekly": 52,
    "fortnightly": 26,
    "monthly": 12,
    "quarterly": 4,
    "annually": 1,
    "oneOff": 0,
}
FREQUENCIES = tuple(FREQUENCIES_PER_YEAR)

TENURES = ("renting", "owning", "other")
ROLES = ("owner", "tenant", "housemate", "viewer")
REMINDER_KINDS = ("payment", "contractRenewal", "meterReading", "custom")
DOCUMENT_KINDS = ("bill", "statement", "meterReading", "receipt", "policy", "other")
PAYMENT_STATUSES = ("unknown", "scheduled", "paid")
BILL_STATES = ("paid", "overdue", "dueSoon", "upcoming", "needsDetails")
READINESS = ("notFound", "needsConfirmation", "needsDetails", "ready")
CONFIDENCES = ("areaCertain", "areaOnly", "unknown")

# Texts that stand in where a document or request names none.
HOUSEHOLD_NAME = "My Home"
OWNER_NAME = "You"
MEMBER_NAME = "Resident"
DOCUMENT_TITLE = "Document"
REMINDER_TITLE = "Reminder"
ADDRESS_SOURCE = "Manual entry"

DOCUMENT_VERSION = 1
DUE_SOON_DAYS = 7
STILL_TO_PAY_DAYS = 30
REMINDER_LEAD_DAYS = 3
MAX_TYPED_AMOUNT = 100_000_000
MIN_BILL_TEXT = 20

# --------------------------------------------------------------------------
# Types
# --------------------------------------------------------------------------


def field_type(value_type: T.DataType) -> T.StructType:
    """Struct type of a field that holds ``value_type``."""
    return T.StructType(
        [
            T.StructField("value", value_type),
            T.StructField("source", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("recorded_at", T.TimestampType()),
            T.StructField("note", T.StringType()),
        ]
    )


TEXT_FIELD = field_type(T.StringType())
MONEY_FIELD = field_type(T.LongType())
DATE_FIELD = field_type(T.DateType())

KEY = "household_id"


# Table schemas as DDL text, for ``spark.read.schema`` and ``createDataFrame``.
_TEXT = TEXT_FIELD.simpleString()
_MONEY = MONEY_FIELD.simpleString()
_DATE = DATE_FIELD.simpleString()

HOUSEHOLDS = (
    "household_id bigint, name string, property_id string, current_member_id string, "
    "onboarding_complete boolean"
)
PROPERTIES = (
    "property_id string, household_id bigint, line1 string, line2 string, town string, "
    "postcode string, uprn string, tenure string, address_source string, is_demo_data boolean"
)
SERVICE_SLOTS = (
    f"slot_id string, household_id bigint, kind string, provider {_TEXT}, "
    f"account_number {_TEXT}, amount_minor {_MONEY}, next_due_date {_DATE}, "
    "frequency string, lookup_keys array<string>, note string"
)
BILLS = (
    f"bill_id string, household_id bigint, kind string, provider {_TEXT}, "
    f"amount_minor {_MONEY}, due_date {_DATE}, period_start date, period_end date, "
    "frequency string, payment_status string, document_id string, notes string, "
    "created_at timestamp, updated_at timestamp"
)
DOCUMENTS = (
    "document_id string, household_id bigint, kind string, title string, "
    "provider_name string, file_name string, content_type string, byte_size bigint, "
    "storage_key string, extracted_text string, notes string, bill_id string, "
    "created_at timestamp"
)
REMINDERS = (
    "reminder_id string, household_id bigint, kind string, title string, due_at date, "
    "note string, bill_id string, is_done boolean"
)
MEMBERS = (
    "member_id string, household_id bigint, name string, email string, role string, "
    "has_accepted_invite boolean, is_current_user boolean, pos bigint"
)
