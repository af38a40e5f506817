"""State changes as bulk folds: a state table and a table of commands give the new state.

Commands carry a growing ``seq``. A fold first reduces the commands of each target to
one row with aggregates that combine on the map side (``max``, ``max_by``), so a target
with very many commands never has them gathered in one place, and then joins that
row to the state. State is joined, not grouped: rows without commands pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, rules as R, scalars as X
from hearthbook.operators.relations import current_members
from hearthbook.sources.dimensions import default_lookup_keys

SLOT_KEY = [S.KEY, "kind"]


def latest(patches: DataFrame, key: Sequence[str], fields: Sequence[str],
           order: str = "seq") -> DataFrame:
    """Last non-null value of each field per key, as ``_new_<field>``."""
    return patches.groupBy(*key).agg(
        *[
            F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(order))).alias(f"_new_{name}")
            for name in fields
        ]
    )


def patch(state: DataFrame, patches: DataFrame, key: Sequence[str], fields: Sequence[str],
          order: str = "seq") -> DataFrame:
    """Overwrite the patched fields, last patch wins, each field on its own."""
    joined = state.join(latest(patches, key, fields, order), list(key), "left")
    return joined.select(
        *[
            F.coalesce(f"_new_{name}", name).alias(name) if name in fields else F.col(name)
            for name in state.columns
        ]
    )


def fresh(inserts: DataFrame, state: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """One insert per id that the state doesn't hold yet: the last by ``order``, where there is one.

    Of inserts that tie, the greatest counts. The state is only looked up by the ids that
    are inserted, so few inserts don't shuffle it.
    """
    names = [name for name in inserts.columns if name != key]
    ordered = [order] if order in names else []
    newest = inserts.groupBy(key).agg(F.max(F.struct(*ordered, *[n for n in names if n not in ordered])).alias("_row"))
    there = state.select(key).join(inserts.select(key), key, "left_semi")
    kept = [name for name in names if name != "seq" or name in state.columns]
    return newest.join(there, key, "left_anti").select(key, *[F.col("_row")[name].alias(name) for name in kept])


def fold(state: DataFrame, key: str, inserts: DataFrame | None = None,
         patches: DataFrame | None = None, fields: Sequence[str] = (),
         deletes: DataFrame | None = None) -> DataFrame:
    """Insert, patch and delete by id. An id is used once: a deleted row stays deleted.

    Inserts are taken once per id (see ``fresh``), so a batch may be applied again.
    """
    rows = state
    if inserts is not None:
        rows = rows.unionByName(fresh(inserts, state, key), allowMissingColumns=True)
    if deletes is not None:
        rows = rows.join(deletes.select(key), key, "left_anti").select(*state.columns)
    if patches is not None:
        rows = patch(rows, patches, [key], fields)
    return rows


# ---- households -----------------------------------------------------------


def create_households(requests: DataFrame) -> dict[str, DataFrame]:
    """Tables for new households from validated requests.

    ``requests``: ``household_id, name, line1, line2, town, postcode, uprn, tenure,
    address_source, is_demo_data, services array<string>, resident_name``. No services
    means the default ones; repeated kinds count once, in first-mention order.
    """
    key = F.col(S.KEY).cast("string")
    member_id = F.concat(F.lit("member-"), key)
    property_id = F.concat(F.lit("prop-"), key)
    default = coerce.names(S.DEFAULT_SERVICES)
    wanted = F.when(F.coalesce(F.size("services"), F.lit(0)) > 0, F.col("services")).otherwise(default)
    households = requests.select(
        S.KEY,
        F.coalesce(coerce.non_blank(F.col("name")), F.lit(S.HOUSEHOLD_NAME)).alias("name"),
        property_id.alias("property_id"),
        member_id.alias("current_member_id"),
        F.lit(False).alias("onboarding_complete"),
    )
    properties = requests.select(
        property_id.alias("property_id"),
        S.KEY,
        coerce.trim(F.col("line1")).alias("line1"),
        coerce.non_blank(F.col("line2")).alias("line2"),
        coerce.trim(F.col("town")).alias("town"),
        X.normalise_postcode(F.col("postcode")).alias("postcode"),
        coerce.non_blank(F.col("uprn")).alias("uprn"),
        "tenure",
        F.coalesce("address_source", F.lit(S.ADDRESS_SOURCE)).alias("address_source"),
        F.coalesce("is_demo_data", F.lit(False)).alias("is_demo_data"),
    )
    chosen = requests.select(S.KEY, F.posexplode(F.array_distinct(wanted)).alias("pos", "kind"))
    members = requests.select(
        member_id.alias("member_id"),
        S.KEY,
        F.coalesce(coerce.non_blank(F.col("resident_name")), F.lit(S.OWNER_NAME)).alias("name"),
        F.lit(None).cast("string").alias("email"),
        F.lit("owner").alias("role"),
        F.lit(True).alias("has_accepted_invite"),
        F.lit(True).alias("is_current_user"),
        F.lit(0).cast("bigint").alias("pos"),
    )
    return {
        "households": households,
        "properties": properties,
        "service_slots": empty_slots(chosen),
        "members": members,
    }


def empty_slots(chosen: DataFrame) -> DataFrame:
    """Slots with nothing recorded for ``household_id, kind`` rows; other columns stay."""
    extra = [name for name in chosen.columns if name not in SLOT_KEY]
    return chosen.select(
        F.concat(F.lit("svc-"), F.col(S.KEY).cast("string"), F.lit("-"), F.col("kind")).alias("slot_id"),
        S.KEY,
        "kind",
        P.missing("string").alias("provider"),
        P.missing("string").alias("account_number"),
        P.missing("bigint").alias("amount_minor"),
        P.missing("date").alias("next_due_date"),
        F.lit("monthly").alias("frequency"),
        default_lookup_keys(F.col("kind")).alias("lookup_keys"),
        F.lit(None).cast("string").alias("note"),
        *extra,
    )


def replace_properties(properties: DataFrame, changes: DataFrame) -> DataFrame:
    """Put the latest address in place of the old one; id and demo flag stay."""
    fields = ["line1", "line2", "town", "postcode", "uprn", "tenure", "address_source"]
    newest = changes.groupBy(S.KEY).agg(
        F.max_by(F.struct(*fields), F.col("seq")).alias("_new")
    )
    joined = properties.join(newest, S.KEY, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col(name)).alias(name)
            if name in fields
            else F.col(name)
            for name in properties.columns
        ]
    )


def set_tenure(properties: DataFrame, changes: DataFrame) -> DataFrame:
    return patch(properties, changes, [S.KEY], ["tenure"])


def complete_onboarding(households: DataFrame, commands: DataFrame) -> DataFrame:
    done = commands.select(S.KEY, F.lit(True).alias("onboarding_complete"), F.lit(0).alias("seq"))
    return patch(households, done, [S.KEY], ["onboarding_complete"])


def reset_households(tables: dict[str, DataFrame], resets: DataFrame) -> dict[str, DataFrame]:
    """Remove the named households from every table."""
    gone = resets.select(S.KEY)
    return {name: table.join(gone, S.KEY, "left_anti") for name, table in tables.items()}


# ---- services -------------------------------------------------------------


def answer_providers(slots: DataFrame, commands: DataFrame) -> DataFrame:
    """Replay confirm / reject / set / not_sure on slot providers, in ``seq`` order.

    ``commands``: ``household_id, kind, seq, action, value, ts``. Order matters (a
    confirm after a reject finds nothing to confirm), yet the outcome depends only on
    the last two answers that assign a value (set, reject) and on whether a confirm
    came after them. The last two are taken with a ranking Spark cuts off before the
    shuffle, the last confirm with a plain maximum.
    """
    usable = commands.where(
        (F.col("action") == "reject")
        | ((F.col("action") == "set") & coerce.non_blank(F.col("value")).isNotNull())
    ).select(*SLOT_KEY, "seq", "action", coerce.trim(F.col("value")).alias("value"), "ts")
    newest_first = Window.partitionBy(*SLOT_KEY).orderBy(F.desc("seq"))
    last_two = usable.withColumn("_nth", F.row_number().over(newest_first)).where("_nth <= 2")
    entry = F.struct("seq", "action", "value", "ts")
    assigned = last_two.groupBy(*SLOT_KEY).agg(
        F.max(F.when(F.col("_nth") == 1, entry)).alias("_last"),
        F.max(F.when(F.col("_nth") == 2, entry)).alias("_prior"),
    )
    confirms = (
        commands.where(F.col("action") == "confirm")
        .groupBy(*SLOT_KEY)
        .agg(F.max(F.struct("seq", "ts")).alias("_confirm"))
    )
    joined = slots.join(assigned, SLOT_KEY, "left").join(confirms, SLOT_KEY, "left")

    last, prior, agreed = F.col("_last"), F.col("_prior"), F.col("_confirm")
    before = (
        F.when(prior.isNull(), F.col("provider")["value"])
        .when(prior["action"] == "set", prior["value"])
    )
    answered = (
        F.when(last["action"] == "set", P.edited(last["value"], last["ts"]))
        .when(last["action"] == "reject", P.missing("string", P.rejection_note(before)))
        .otherwise(F.col("provider"))
    )
    settled = joined.withColumn("_answered", answered)
    agreed_after = agreed.isNotNull() & (
        last.isNull() | (agreed["seq"] > last["seq"])
    )
    final = F.when(agreed_after, P.confirm(F.col("_answered"), agreed["ts"])).otherwise(
        F.col("_answered")
    )
    return settled.withColumn("_final", final).select(
        *[F.col("_final").alias("provider") if c == "provider" else F.col(c) for c in slots.columns]
    )


def edit_slots(slots: DataFrame, edits: DataFrame) -> DataFrame:
    """Set account number, amount, frequency and next due date, each on its own.

    ``edits``: ``household_id, kind, seq`` and the nullable ``account_number, amount_minor,
    frequency, next_due_date (text)``; null means not mentioned. A blank account number
    or an unreadable date clears the field; an amount that is not positive is ignored
    (validation reports it). The optional ``ts`` is when the edit was made.
    """
    usable = edits.withColumn("amount_minor", F.when(F.col("amount_minor") > 0, F.col("amount_minor")))
    names = ["account_number", "amount_minor", "frequency", "next_due_date"]
    made = _time_of(edits)
    stamped = usable.select(
        *SLOT_KEY, "seq",
        *[F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("value"), made.alias("at"))).alias(n) for n in names],
    )
    joined = slots.join(latest(stamped, SLOT_KEY, names), SLOT_KEY, "left")
    account, amount, due = (F.col(f"_new_{n}") for n in ("account_number", "amount_minor", "next_due_date"))
    changed = {
        "account_number": F.when(account.isNotNull(), P.edited(coerce.non_blank(account["value"]), account["at"])),
        "amount_minor": F.when(amount.isNotNull(), P.edited(amount["value"], amount["at"])),
        "frequency": F.col("_new_frequency")["value"],
        "next_due_date": F.when(due.isNotNull(), P.edited(coerce.date(due["value"]), due["at"])),
    }
    return joined.select(
        *[
            F.coalesce(changed[name], F.col(name)).alias(name) if name in changed else F.col(name)
            for name in slots.columns
        ]
    )


def _time_of(commands: DataFrame) -> Column:
    """When commands were given; null where they don't say."""
    return (F.col("ts") if "ts" in commands.columns else F.lit(None)).cast("timestamp")


def slot_form_edits(forms: DataFrame) -> DataFrame:
    """A filled-in details form as commands and edits: blanks mean keep the old value.

    ``forms``: ``household_id, kind, seq, provider, account_number, amount_text,
    frequency, next_due_date (date)`` and the optional ``ts``. Only a non-blank provider or account number, a
    positive amount (with its frequency) and a known date are passed on.
    """
    minor = X.parse_money(F.col("amount_text"))
    amount = F.when(minor > 0, minor)
    return forms.select(
        *SLOT_KEY,
        "seq",
        coerce.non_blank(F.col("provider")).alias("value"),
        coerce.non_blank(F.col("account_number")).alias("account_number"),
        amount.alias("amount_minor"),
        F.when(amount.isNotNull(), F.col("frequency")).alias("frequency"),
        F.col("next_due_date").cast("string").alias("next_due_date"),
        _time_of(forms).alias("ts"),
    )


def apply_slot_forms(slots: DataFrame, forms: DataFrame) -> DataFrame:
    edits = slot_form_edits(forms)
    named = edits.where(F.col("value").isNotNull()).select(
        *SLOT_KEY, "seq", F.lit("set").alias("action"), "value", "ts",
    )
    return edit_slots(answer_providers(slots, named), edits)


def change_slots(slots: DataFrame, commands: DataFrame) -> DataFrame:
    """Add and remove services, in ``seq`` order.

    ``commands``: ``household_id, kind, seq, action`` (add / remove). Adding a kind that
    exists does nothing; adding it after a removal gives an empty slot.
    """
    seq = F.col("seq")
    outcome = commands.groupBy(*SLOT_KEY).agg(
        F.max(F.when(F.col("action") == "add", seq)).alias("_added"),
        F.max(F.when(F.col("action") == "remove", seq)).alias("_removed"),
    )
    removed = outcome.where(F.col("_removed").isNotNull())
    kept = slots.join(removed.select(*SLOT_KEY), SLOT_KEY, "left_anti").select(*slots.columns)
    wanted = outcome.where(
        F.col("_added").isNotNull()
        & (F.col("_removed").isNull() | (F.col("_added") > F.col("_removed")))
    )
    fresh = empty_slots(
        wanted.select(*SLOT_KEY).join(kept.select(*SLOT_KEY), SLOT_KEY, "left_anti")
    )
    return kept.unionByName(fresh.select(*slots.columns))


def sync_slots(slots: DataFrame, bills: DataFrame) -> DataFrame:
    """Bring slots in step with the latest confirmed, non-estimate bill of their kind.

    Provider (where the bill has one), amount with frequency, and date (where known)
    each come from the newest bill that has them, and are recorded at its ``updated_at``. What
    a slot has recorded since then stays.
    """
    sure = P.is_confirmed(F.col("amount_minor")) & ~P.is_estimate(F.col("amount_minor"))
    newest = F.struct(F.col("updated_at"), F.col("bill_id"))
    provider = coerce.non_blank(F.col("provider")["value"])
    due = F.col("due_date")["value"]
    at = F.col("updated_at").cast("timestamp").alias("at")
    latest_bill = (
        bills.where(sure)
        .groupBy(*SLOT_KEY)
        .agg(
            F.max_by(F.struct(provider.alias("value"), at), F.when(provider.isNotNull(), newest)).alias("_provider"),
            F.max_by(F.struct(F.col("amount_minor")["value"].alias("value"), "frequency", at), newest).alias(
                "_amount"
            ),
            F.max_by(F.struct(due.alias("value"), at), F.when(due.isNotNull(), newest)).alias("_due"),
        )
    )
    joined = slots.join(latest_bill, SLOT_KEY, "left")

    def is_newer(found: str, name: str) -> Column:
        recorded_later = F.coalesce(F.col(name)["recorded_at"] > F.col(found)["at"], F.lit(False))
        return F.col(found).isNotNull() & ~recorded_later

    changed = {
        name: F.when(is_newer(found, name), P.edited(F.col(found)["value"], F.col(found)["at"]))
        for name, found in (("provider", "_provider"), ("amount_minor", "_amount"), ("next_due_date", "_due"))
    }
    changed["frequency"] = F.when(is_newer("_amount", "amount_minor"), F.col("_amount")["frequency"])
    return joined.select(
        *[
            F.coalesce(changed[name], F.col(name)).alias(name) if name in changed else F.col(name)
            for name in slots.columns
        ]
    )


# ---- bills, reminders, documents ------------------------------------------

BILL_PATCH_FIELDS = ["provider", "amount_minor", "due_date", "frequency", "payment_status", "notes"]


def paid_patches(commands: DataFrame) -> DataFrame:
    """``bill_id, seq, paid`` commands as patches: not paid goes back to unknown."""
    return commands.select(
        "bill_id", "seq", F.when(F.col("paid"), "paid").otherwise("unknown").alias("payment_status")
    )


def change_bills(bills: DataFrame, inserts: DataFrame | None = None,
                 patches: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Insert, patch and delete bills. Patches hold any of ``BILL_PATCH_FIELDS``.

    A null means not mentioned; a blank note clears the note.
    """
    fields = [] if patches is None else [f for f in BILL_PATCH_FIELDS if f in patches.columns]
    changed = fold(bills, "bill_id", inserts, patches, fields, deletes)
    return changed.withColumn("notes", coerce.non_blank(F.col("notes"))) if "notes" in fields else changed


def reminders_from_bills(bills: DataFrame, as_of: R.Day) -> DataFrame:
    """A payment reminder for every dated unpaid bill, some days ahead, never in the past."""
    day = F.expr(R.day(as_of))
    due = F.col("due_date")["value"]
    unpaid = bills.where(~R.is_paid() & due.isNotNull())
    return unpaid.select(
        F.concat(F.lit("rem-"), F.col("bill_id")).alias("reminder_id"),
        S.KEY,
        F.lit("payment").alias("kind"),
        F.concat(X.kind_label(F.col("kind")), F.lit(" payment")).alias("title"),
        F.greatest(F.date_sub(due, S.REMINDER_LEAD_DAYS), day).alias("due_at"),
        F.lit("from_bill_due_date").alias("note"),
        "bill_id",
        F.lit(False).alias("is_done"),
    )


def change_reminders(reminders: DataFrame, inserts: DataFrame | None = None,
                     patches: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Insert, tick off, retitle, redate and delete reminders."""
    fields = [] if patches is None else [f for f in ("title", "due_at", "is_done") if f in patches.columns]
    return fold(reminders, "reminder_id", inserts, patches, fields, deletes)


def change_documents(documents: DataFrame, inserts: DataFrame | None = None,
                     deletes: DataFrame | None = None) -> DataFrame:
    return fold(documents, "document_id", inserts, deletes=deletes)


# ---- members --------------------------------------------------------------


def change_members(households: DataFrame, members: DataFrame, invites: DataFrame | None = None,
                   roles: DataFrame | None = None, removals: DataFrame | None = None,
                   choices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Invite, change role, remove and choose members; returns households and members.

    ``invites``: ``member_id, household_id, name, email, role, seq``, placed after the
    members there are; a repeated invite counts once. ``choices``: ``household_id, member_id, seq``. When the current
    member is gone the first one left takes over.
    """
    rows = members
    if invites is not None:
        last = members.groupBy(S.KEY).agg(F.max("pos").alias("_last"))
        added = invites.join(last, S.KEY, "left").select(
            "member_id",
            S.KEY,
            coerce.trim(F.col("name")).alias("name"),
            coerce.trim(F.col("email")).alias("email"),
            "role",
            F.lit(False).alias("has_accepted_invite"),
            F.lit(False).alias("is_current_user"),
            (F.coalesce("_last", F.lit(-1)) + 1 + F.col("seq")).alias("pos"),
        )
        rows = rows.withColumn("pos", F.col("pos").cast("bigint")).unionByName(fresh(added, members, "member_id", "pos"))
    if removals is not None:
        rows = rows.join(removals.select("member_id"), "member_id", "left_anti").select(*rows.columns)
    if roles is not None:
        rows = patch(rows, roles, ["member_id"], ["role"])
    chosen = households
    if choices is not None:
        picks = choices.select(S.KEY, "seq", F.col("member_id").alias("current_member_id"))
        chosen = patch(chosen, picks, [S.KEY], ["current_member_id"])
    acting = current_members(chosen, rows).select(S.KEY, F.col("member_id").alias("_acting"))
    settled = chosen.join(acting, S.KEY, "left").select(
        *[
            F.col("_acting").alias(name) if name == "current_member_id" else F.col(name)
            for name in chosen.columns
        ]
    )
    return settled, rows
