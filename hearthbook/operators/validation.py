"""Validation: split a table into accepted rows and rejected rows with reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, scalars as X

Rules = dict[str, Column]


def check(rows: DataFrame, rules: Rules) -> DataFrame:
    """Add ``codes``: the rules each row breaks. A rule is true where it is broken."""
    broken = [F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items()]
    return rows.withColumn("codes", F.array_compact(F.array(*broken)))


def split(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(accepted without codes, rejected with codes)."""
    checked = check(rows, rules)
    sound = F.size("codes") == 0
    return checked.where(sound).drop("codes"), checked.where(~sound)


def _blank(name: str) -> Column:
    return coerce.non_blank(F.col(name)).isNull()


def _unknown(name: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))


def household_rules() -> Rules:
    known = coerce.names(S.SERVICE_KINDS)
    return {
        "line1_required": _blank("line1"),
        "town_required": _blank("town"),
        "postcode_required": _blank("postcode"),
        "unknown_tenure": _unknown("tenure", S.TENURES),
        "unknown_service": F.size(F.array_except("services", known)) > 0,
    }


def bill_rules() -> Rules:
    """A new bill: the kind must be known and the amount present and positive."""
    amount = F.col("amount_minor")["value"]
    return {
        "unknown_kind": _unknown("kind", S.SERVICE_KINDS),
        "amount_required": amount.isNull(),
        "amount_not_positive": amount <= 0,
    }


def bill_update_rules() -> Rules:
    """Only what an update mentions is checked: ``payment_status``, ``amount_minor`` (a field)."""
    status = F.col("payment_status")
    named = F.col("amount_minor")
    value = named["value"]
    return {
        "unknown_payment_status": status.isNotNull() & _unknown("payment_status", S.PAYMENT_STATUSES),
        "amount_not_positive": named.isNotNull() & (value.isNull() | (value <= 0)),
    }


def slot_update_rules() -> Rules:
    """Rows of ``check_slot_updates``: an update next to its slot's provider value."""
    action = F.col("action")
    amount = coerce.to_int(F.col("amount_text"))
    return {
        "unknown_action": action.isNotNull() & ~action.isin("confirm", "reject", "set", "not_sure"),
        "nothing_to_confirm": (action == "confirm") & F.col("current_value").isNull(),
        "provider_required": (action == "set") & _blank("value"),
        "amount_not_positive": F.col("amount_text").isNotNull()
        & ~F.coalesce(amount > 0, F.lit(False)),
    }


def check_slot_updates(updates: DataFrame, slots: DataFrame) -> DataFrame:
    """Slot updates with codes; the confirm rule looks at the slot as it is now.

    Slots grow with the households, so they are merged and not broadcast, whatever Spark takes their size for.
    """
    current = slots.select(S.KEY, "kind", F.col("provider")["value"].alias("current_value"))
    return check(updates.join(current.hint("merge"), [S.KEY, "kind"], "left"), slot_update_rules())


def reminder_rules() -> Rules:
    """Request rows: ``title`` and ``due_text``. A reminder date is never guessed."""
    return {
        "title_required": _blank("title"),
        "date_required": coerce.date(F.col("due_text")).isNull(),
    }


def reminder_update_rules() -> Rules:
    return {
        "title_required": F.col("title").isNotNull() & _blank("title"),
        "date_required": F.col("due_text").isNotNull() & coerce.date(F.col("due_text")).isNull(),
    }


def document_rules() -> Rules:
    return {"title_required": _blank("title")}


def field_rules(*names: str) -> Rules:
    """The field invariants of every named column, codes prefixed with its name."""
    codes = ("unknown_source", "unknown_status", "status_without_value", "value_without_status")
    return {
        f"{name}:{code}": F.array_contains(P.violations(F.col(name)), code)
        for name in names
        for code in codes
    }


def enum_rules() -> Rules:
    """Warnings for names that tolerant reading will replace by a default."""
    return {
        "unknown_kind": _unknown("kind", S.SERVICE_KINDS),
        "unknown_frequency": _unknown("frequency", S.FREQUENCIES),
        "unknown_payment_status": _unknown("payment_status", S.PAYMENT_STATUSES),
    }


def typed_amount_rules(name: str) -> Rules:
    minor = X.parse_money(F.col(name))
    return {
        "unreadable": minor.isNull(),
        "not_positive": minor <= 0,
        "too_large": minor > S.MAX_TYPED_AMOUNT,
    }


def bill_form_rules() -> Rules:
    """A typed bill: ``date_known`` needs ``due_date`` (a date)."""
    return {"date_required": F.col("date_known") & F.col("due_date").isNull()}


def accepted_text_rules() -> Rules:
    """A bill accepted from text needs an amount and a date."""
    return {
        "amount_required": F.col("amount_minor").isNull(),
        "date_required": F.col("due_date").isNull(),
    }


def duplicate_slots(slots: DataFrame) -> DataFrame:
    """(household, kind) pairs that occur more than once."""
    counts = slots.groupBy(S.KEY, "kind").agg(F.count("*").alias("slot_count"))
    return counts.where(F.col("slot_count") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: str = S.KEY) -> DataFrame:
    """Child rows whose parent does not exist; a null key refers to nothing and is fine."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


EDIT_ACTIONS = ("bill_insert", "bill_update", "bill_delete", "set_paid", "confirm", "reject", "set")
MANAGE_ACTIONS = ("member_add", "member_role", "member_remove", "reset", "replace_property")
#: What any member may do.
OPEN_ACTIONS = (
    "not_sure", "add", "remove", "edit_slot", "set_tenure", "complete_onboarding", "choose_member",
    "reminder_insert", "reminder_update", "reminder_delete", "document_insert", "document_delete",
)


def check_permissions(commands: DataFrame, members: DataFrame) -> DataFrame:
    """Commands with codes for what the role of the acting member does not allow.

    ``commands`` has ``household_id, member_id, action``. An unknown member may do
    nothing that needs a permission. An action of no list is reported, not let through.
    """
    roles = members.select(S.KEY, "member_id", "role")
    joined = commands.join(roles, [S.KEY, "member_id"], "left")
    role = F.coalesce("role", F.lit(""))
    action = F.col("action")
    return check(
        joined,
        {
            "unknown_action": _unknown("action", (*EDIT_ACTIONS, *MANAGE_ACTIONS, *OPEN_ACTIONS)),
            "may_not_edit_bills": action.isin(*EDIT_ACTIONS) & ~X.can_edit_bills(role),
            "may_not_manage": action.isin(*MANAGE_ACTIONS) & ~X.can_manage_household(role),
        },
    )
