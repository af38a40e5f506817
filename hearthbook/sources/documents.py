"""Aggregate household documents: JSON with a household's whole state.

A document is one JSON object, or comes as *lines*: a head line with what the household is, and a
line for each item of its lists with its position. Every line is a small document of its own,
so both are read by the same functions, and a household of any size is written and read without a
row or task that holds it. `document_pieces` gives the text of the one object in
order, to be passed on as it comes.

Reading keeps every input row: what cannot be used goes to a quarantine table with a reason. Each
text is parsed once, into typed head members and lists of VARIANT items.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, scalars as X

LISTS = ("services", "bills", "documents", "reminders", "members")

# Members of list items: undecoded ones, names read as text, and provenance fields.
_PLAIN = {
    "services": "id propertyId lookupKeys note",
    "bills": "id propertyId periodStart periodEnd documentId notes createdAt updatedAt",
    "documents": "id propertyId title providerName fileName contentType byteSize storageKey extractedText notes billId addedAt",
    "reminders": "id propertyId title dueAt note billId isDone",
    "members": "id name email hasAcceptedInvite isCurrentUser",
}
_NAMES = {
    "services": "kind frequency", "bills": "kind frequency paymentStatus", "documents": "kind", "reminders": "kind", "members": "role",
}
_FIELDS = {"services": "provider accountNumber amountMinor nextDueDate", "bills": "provider amountMinor dueDate"}

_HOME = ("id", "line1", "line2", "town", "postcode", "uprn", "tenure", "addressSource", "isDemoData")
_HEAD = ("version", "householdId", "itemLine", "pos", "name", "currentMemberId", "onboardingComplete", "isDemoData")


def _document(item: str) -> str:
    """The schema of a document whose lists hold items of a type."""
    members = [f"{name}: variant" for name in _HEAD]
    members.append("property: struct<" + ", ".join(f"{name}: variant" for name in _HOME) + ">")
    return "struct<" + ", ".join(members + [f"{name}: array<{item}>" for name in LISTS]) + ">"


# --------------------------------------------------------------------------
# Reading
# --------------------------------------------------------------------------


def parse_documents(raw: DataFrame, text: str = "json", key: str | None = S.KEY) -> DataFrame:
    """Parse JSON text into ``household_id, item_line, pos, doc, text, reason``.

    ``key`` names the column with the household id; with None it is read from the document's
    ``householdId``. ``reason`` is null for usable documents; ``item_line`` says that the text is the
    line of an item, at ``pos``. Of repeated keys the last one counts. All the tables below read this one; write it, or its
    ``tagged_items``, out first if several of them are wanted.
    """
    parsed = raw.withColumn("_doc", F.coalesce(coerce.whole_object(F.col(text), _document("variant")), _without_lists(F.col(text))))
    doc = F.col("_doc")
    household = coerce.as_int(doc["householdId"]) if key is None else F.col(key)
    reason = (
        F.when(doc.isNull(), coerce.unreadable_text(F.col(text)))
        .when(doc["version"].isNotNull() & ~coerce.as_int(doc["version"]).eqNullSafe(F.lit(S.DOCUMENT_VERSION)), "unknown_version")
        .when(household.isNull(), "no_household_id")
    )
    return parsed.select(
        household.alias(S.KEY), coerce.as_bool(doc["itemLine"]).alias("item_line"), coerce.as_int(doc["pos"]).alias("pos"), doc.alias("doc"), F.col(text).alias("text"), reason.alias("reason")
    )


def _without_lists(text: Column) -> Column:
    """The head members of a document that can't be read with its lists: an item may repeat a key, which no VARIANT does.

    Only looked at for such texts; their lists are read by ``_list``.
    """
    def head(doc: Column) -> Column:
        lists = [F.lit(None).cast("array<variant>").alias(name) for name in LISTS]
        return F.when(doc.isNotNull(), F.struct(*[doc[name].alias(name) for name in (*_HEAD, "property")], *lists, doc["mark"].alias("mark")))

    return F.get(F.transform(F.array(coerce.whole_object(text, _document("string"))), head), F.lit(0))


def quarantine(parsed: DataFrame) -> DataFrame:
    """The documents that could not be used, with the reason and their text."""
    bad = F.when(F.col("reason").isNotNull(), F.struct(S.KEY, "reason", "text"))
    return parsed.select(_one_or_none(bad))


def _one_or_none(row: Column) -> Column:
    """The struct as a row if it is not null: like a filter, but kept above the parsing."""
    return F.inline(F.array_compact(F.array(row)))


def _list(name: str) -> Column:
    """The items of a list of a usable document, null where there are none.

    A VARIANT has no repeated keys, so a list in which an item repeats one does not come
    out of the parse. Such a list is read again, item by item into typed members.
    """
    fields = [f"{n}: struct<{P.STORED}>" for n in _FIELDS.get(name, "").split()]
    members = [f"{n}: variant" for n in _PLAIN[name].split()] + [f"{n}: string" for n in _NAMES[name].split()] + fields
    again = F.from_json(F.col("text"), f"struct<{name}: array<string>>")[name]
    typed = F.transform(again, lambda item: F.to_variant_object(F.from_json(item, f"struct<{', '.join(members)}>")))
    missed = F.when(F.contains(F.col("text"), F.lit(f'"{name}"')), typed)
    return F.when(F.col("reason").isNull(), F.coalesce(F.col("doc")[name], missed))


def tagged_items(parsed: DataFrame, lists: Sequence[str] = LISTS) -> DataFrame:
    """``household_id, list, pos, item (VARIANT)``: the items of several lists from one parse of each text.

    What the readers of lists make tables of. ``pos`` is the item's place in its list, from 0, or
    what its line says.
    """
    def tagged(name: str) -> Column:
        return F.transform(
            _list(name), lambda item, i: F.struct(F.lit(name).alias("list"), F.when(F.col("item_line"), F.col("pos")).otherwise(i).alias("pos"), item.alias("item"))
        )

    several = [F.coalesce(tagged(name), F.array().cast("array<struct<list: string, pos: bigint, item: variant>>")) for name in lists]
    return parsed.select(S.KEY, F.inline(F.concat(*several) if len(several) > 1 else several[0]))


def _items(source: DataFrame, name: str) -> DataFrame:
    """One row per list item that is an object with an id, from parsed documents or tagged items.

    Columns: the household, ``pos``, ``s`` (the undecoded plain members as a struct, enum
    names as text) and one undecoded struct per provenance field.
    """
    tagged = source if "item" in source.columns else tagged_items(source, [name])
    item, fields = F.col("item"), _FIELDS.get(name, "").split()
    named = tagged.where((F.col("list") == name) & (coerce.as_string(coerce.child(item, "$.id")) != ""))
    opened = named.select(
        S.KEY, "pos", coerce.members(item, *_PLAIN[name].split(), *fields, texts=_NAMES[name].split()).alias("s")
    )
    if not fields:
        return opened
    return opened.select("*", *[P.nodes(F.col("s")[field]).alias(field) for field in fields])


def _node(name: str) -> Column:
    return F.col("s")[name]


def _text(name: str, fallback: str = "") -> Column:
    return coerce.as_string(_node(name), fallback)


def _optional(name: str) -> Column:
    return coerce.as_string_or_null(_node(name))


def value_text(node: Column) -> Column:
    """Text of a field value: scalars as text, nothing for lists and objects."""
    return F.nullif(coerce.as_string(node, "\0"), F.lit("\0"))


def _field(name: str, as_value: Callable[[Column], Column]) -> Column:
    return P.decode(F.col(name), as_value)


def _heads_of(parsed: DataFrame, wanted: Column, node: Column) -> DataFrame:
    """``household_id, s``: the node of each head (a whole document, or the head line) that is wanted."""
    head = F.struct(S.KEY, node.alias("s"))
    return parsed.select(_one_or_none(F.when(F.col("reason").isNull() & ~F.col("item_line") & wanted, head)))


def read_households(parsed: DataFrame) -> DataFrame:
    heads = _heads_of(parsed, F.lit(True), F.col("doc"))
    return heads.select(
        S.KEY,
        _optional("name").alias("name"),
        coerce.as_string_or_null(_node("property")["id"]).alias("property_id"),
        _optional("currentMemberId").alias("current_member_id"),
        coerce.as_bool(_node("onboardingComplete")).alias("onboarding_complete"),
        coerce.as_bool(_node("isDemoData")).alias("is_demo_data"),
    )


def read_properties(parsed: DataFrame) -> DataFrame:
    home = F.col("doc")["property"]
    heads = _heads_of(parsed, home.isNotNull(), home)
    return heads.where(_text("id") != "").select(
        _text("id").alias("property_id"),
        S.KEY,
        _text("line1").alias("line1"),
        _optional("line2").alias("line2"),
        _text("town").alias("town"),
        _text("postcode").alias("postcode"),
        _optional("uprn").alias("uprn"),
        X.tenure(_text("tenure")).alias("tenure"),
        _text("addressSource", S.ADDRESS_SOURCE).alias("address_source"),
        coerce.as_bool(_node("isDemoData")).alias("is_demo_data"),
    )


def read_slots(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "services").select(
        _text("id").alias("slot_id"),
        S.KEY,
        X.service_kind(_node("kind")).alias("kind"),
        _field("provider", value_text).alias("provider"),
        _field("accountNumber", value_text).alias("account_number"),
        _field("amountMinor", coerce.as_int).alias("amount_minor"),
        _field("nextDueDate", coerce.as_date).alias("next_due_date"),
        X.frequency(_node("frequency")).alias("frequency"),
        coerce.as_string_list(_node("lookupKeys")).alias("lookup_keys"),
        _optional("note").alias("note"),
        _optional("propertyId").alias("property_id"),
    )


BILL_VALUES = {"provider": value_text, "amountMinor": coerce.as_int, "dueDate": coerce.as_date}


def read_bills(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "bills").select(
        _text("id").alias("bill_id"),
        S.KEY,
        X.service_kind(_node("kind")).alias("kind"),
        _field("provider", value_text).alias("provider"),
        _field("amountMinor", coerce.as_int).alias("amount_minor"),
        _field("dueDate", coerce.as_date).alias("due_date"),
        coerce.as_date(_node("periodStart")).alias("period_start"),
        coerce.as_date(_node("periodEnd")).alias("period_end"),
        X.frequency(_node("frequency")).alias("frequency"),
        X.payment_status(_node("paymentStatus")).alias("payment_status"),
        _optional("documentId").alias("document_id"),
        _optional("notes").alias("notes"),
        coerce.as_timestamp(_node("createdAt")).alias("created_at"),
        coerce.as_timestamp(_node("updatedAt")).alias("updated_at"),
        _optional("propertyId").alias("property_id"),
    )


def unreadable_values(parsed: DataFrame) -> DataFrame:
    """Bill values that are present but have no readable form (read as missing)."""
    items = _items(parsed, "bills")
    codes = [F.when(P.undecodable(F.col(n), reader), n) for n, reader in BILL_VALUES.items()]
    return items.select(
        S.KEY, _text("id").alias("bill_id"), F.explode(F.array_compact(F.array(*codes))).alias("unreadable")
    )


def read_documents(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "documents").select(
        _text("id").alias("document_id"),
        S.KEY,
        X.document_kind(_node("kind")).alias("kind"),
        _text("title", S.DOCUMENT_TITLE).alias("title"),
        _optional("providerName").alias("provider_name"),
        _optional("fileName").alias("file_name"),
        _optional("contentType").alias("content_type"),
        coerce.as_int(_node("byteSize")).alias("byte_size"),
        _optional("storageKey").alias("storage_key"),
        _optional("extractedText").alias("extracted_text"),
        _optional("notes").alias("notes"),
        _optional("billId").alias("bill_id"),
        coerce.as_timestamp(_node("addedAt")).alias("created_at"),
        _optional("propertyId").alias("property_id"),
    )


def read_reminders(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "reminders").select(
        _text("id").alias("reminder_id"),
        S.KEY,
        X.reminder_kind(_node("kind")).alias("kind"),
        _text("title", S.REMINDER_TITLE).alias("title"),
        coerce.as_date(_node("dueAt")).alias("due_at"),
        _optional("note").alias("note"),
        _optional("billId").alias("bill_id"),
        coerce.as_bool(_node("isDone")).alias("is_done"),
        _optional("propertyId").alias("property_id"),
    )


def read_members(parsed: DataFrame) -> DataFrame:
    return _items(parsed, "members").select(
        _text("id").alias("member_id"),
        S.KEY,
        _text("name", S.MEMBER_NAME).alias("name"),
        _optional("email").alias("email"),
        X.role(_node("role")).alias("role"),
        coerce.as_bool(_node("hasAcceptedInvite"), True).alias("has_accepted_invite"),
        coerce.as_bool(_node("isCurrentUser")).alias("is_current_user"),
        F.col("pos").cast("bigint").alias("pos"),
    )


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "households": read_households,
    "properties": read_properties,
    "service_slots": read_slots,
    "bills": read_bills,
    "documents": read_documents,
    "reminders": read_reminders,
    "members": read_members,
}


def household_tables(parsed: DataFrame, items: DataFrame | None = None) -> dict[str, DataFrame]:
    """All ledger tables of the parsed documents; lists from ``items`` if these are given (``tagged_items``, written out)."""
    heads = ("households", "properties")
    return {name: read(parsed if items is None or name in heads else items) for name, read in READERS.items()}


# --------------------------------------------------------------------------
# Writing
# --------------------------------------------------------------------------


def _json(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _field_json(name: str, alias: str) -> Column:
    field = F.col(name)
    return F.struct(
        field["value"].alias("value"),
        F.coalesce(field["source"], F.lit("none")).alias("source"),
        F.coalesce(field["status"], F.lit("missing")).alias("status"),
        field["recorded_at"].alias("recordedAt"),
        field["note"].alias("note"),
    ).alias(alias)


def _micros(name: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(name)), F.lit(0))


def _entry(table: DataFrame, name: str, pos: Column, key: str, *members: Column | str) -> DataFrame:
    """``household_id, list, pos, id, body``: the rows of a table as items of a list; list counts from 1."""
    return table.select(
        S.KEY, F.lit(LISTS.index(name) + 1).alias("list"), pos.cast("bigint").alias("pos"), F.col(key).alias("id"), _json(*members).alias("body")
    )


def _with_property(table: DataFrame, homes: DataFrame) -> DataFrame:
    """The table with ``property_id``, its own or else that of its household."""
    return table if "property_id" in table.columns else table.join(homes, S.KEY, "left")


def _entries(tables: dict[str, DataFrame], with_text: bool) -> DataFrame:
    """All items of all lists; ``pos`` and then ``id`` are the order of a list.

    Documents name the property in each item, and hold transcripts; payloads do neither.
    """
    homes = tables["properties"].groupBy(S.KEY).agg(F.min("property_id").alias("property_id"))
    home = [F.coalesce("property_id", F.lit("")).alias("propertyId")] if with_text else []

    def placed(name: str) -> DataFrame:
        return _with_property(tables[name], homes) if with_text else tables[name]

    slots = _entry(
        placed("service_slots"), "services", X.kind_ordinal(F.col("kind")), "slot_id",
        F.col("slot_id").alias("id"), *home, "kind",
        _field_json("provider", "provider"), _field_json("account_number", "accountNumber"), _field_json("amount_minor", "amountMinor"),
        "frequency", _field_json("next_due_date", "nextDueDate"), F.col("lookup_keys").alias("lookupKeys"), "note",
    )
    bills = _entry(
        placed("bills"), "bills", _micros("created_at"), "bill_id",
        F.col("bill_id").alias("id"), *home, "kind",
        _field_json("provider", "provider"), _field_json("amount_minor", "amountMinor"), _field_json("due_date", "dueDate"),
        F.col("period_start").alias("periodStart"), F.col("period_end").alias("periodEnd"), "frequency",
        F.col("payment_status").alias("paymentStatus"), F.col("document_id").alias("documentId"), "notes",
        F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"),
    )
    documents = _entry(
        placed("documents"), "documents", -_micros("created_at"), "document_id",
        F.col("document_id").alias("id"), *home, "kind", "title",
        F.col("provider_name").alias("providerName"), F.col("file_name").alias("fileName"), F.col("content_type").alias("contentType"),
        F.col("byte_size").alias("byteSize"), F.col("storage_key").alias("storageKey"),
        *([F.col("extracted_text").alias("extractedText")] if with_text else []),
        "notes", F.col("bill_id").alias("billId"), F.col("created_at").alias("addedAt"),
    )
    reminders = _entry(
        placed("reminders"), "reminders", F.unix_date("due_at"), "reminder_id",
        F.col("reminder_id").alias("id"), *home, "kind", "title", F.col("due_at").alias("dueAt"), "note",
        F.col("bill_id").alias("billId"), F.col("is_done").alias("isDone"),
    )
    members = _entry(
        tables["members"], "members", F.col("pos"), "member_id",
        F.col("member_id").alias("id"), "name", "role", "email",
        F.col("is_current_user").alias("isCurrentUser"), F.col("has_accepted_invite").alias("hasAcceptedInvite"),
    )
    return reduce(DataFrame.unionByName, [slots, bills, documents, reminders, members])


def _heads(households: DataFrame, properties: DataFrame, items: DataFrame, *columns: Column) -> DataFrame:
    """``household_id, body``: what a document says before its lists.

    A property of an unknown household has a head too, and so has a household of which only items are known.
    """
    home = properties.select(
        S.KEY,
        F.struct(
            F.col("property_id").alias("id"),
            "line1",
            "line2",
            "town",
            "postcode",
            "uprn",
            "tenure",
            F.col("address_source").alias("addressSource"),
            F.col("is_demo_data").alias("isDemoData"),
        ).alias("property"),
    )
    known = households.join(home, S.KEY, "full")
    strays = items.select(S.KEY).distinct().join(known, S.KEY, "left_anti").select(S.KEY, F.lit('{"property":null}').alias("body"))
    return known.select(S.KEY, _json(*columns, F.col("property")).alias("body")).unionByName(strays)


def _opening() -> Column:
    return F.concat(F.lit('{"version":' + str(S.DOCUMENT_VERSION) + ',"householdId":'), F.coalesce(F.col(S.KEY).cast("string"), F.lit("null")), F.lit(","))


def _inside(body: Column) -> Column:
    """The members of an object, without its braces."""
    return F.substr(body, F.lit(2), F.length(body) - 2)


def _lines(heads: DataFrame, items: DataFrame) -> DataFrame:
    """``household_id, list, pos, id, json``: a head line per household (list 0) and a line per item."""
    head = heads.select(
        S.KEY, F.lit(0).alias("list"), F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("id"),
        F.concat(_opening(), _inside(F.col("body")), F.lit("}")).alias("json"),
    )
    place = F.coalesce(F.col("pos").cast("string"), F.lit("null"))
    item = F.concat(
        _opening(), F.lit('"itemLine":true,"pos":'), place, F.lit(',"'), F.element_at(coerce.names(LISTS), F.col("list")), F.lit('":['), F.col("body"), F.lit("]}")
    )
    return head.unionByName(items.select(S.KEY, "list", "pos", "id", item.alias("json")))


def _pieces(heads: DataFrame, items: DataFrame) -> DataFrame:
    """``household_id, list, kind, pos, id, piece``: text that in the order of these columns is one JSON object per household.

    Before the items of each list stands a piece that opens it (kind 0); a last one closes the object.
    Nothing is gathered: the first item of each list, which has no comma before it, is found by a minimum.
    """
    opens = F.array(*[
        F.struct(
            F.lit(i + 1).alias("list"),
            (F.concat(_opening(), _inside(F.col("body")), F.lit(',"' + name + '":[')) if i == 0 else F.lit('],"' + name + '":[')).alias("piece"),
        )
        for i, name in enumerate(LISTS)
    ], F.struct(F.lit(len(LISTS) + 1).alias("list"), F.lit("]}").alias("piece")))
    frames = heads.select(S.KEY, F.inline(opens)).select(
        S.KEY, "list", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("id"), "piece"
    )
    first = items.groupBy(S.KEY, "list").agg(F.min(F.struct("pos", "id")).alias("first"))
    leads = F.struct("pos", "id").eqNullSafe(F.col("first"))
    return frames.unionByName(
        items.join(first, [S.KEY, "list"]).select(
            S.KEY, "list", F.lit(1).alias("kind"), "pos", "id", F.concat(F.when(leads, "").otherwise(","), F.col("body")).alias("piece")
        )
    )


def _document_parts(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    own = "is_demo_data" in tables["households"].columns
    items = _entries(tables, True)
    heads = _heads(
        tables["households"], tables["properties"], items,
        F.col("name"),
        F.col("current_member_id").alias("currentMemberId"),
        F.col("onboarding_complete").alias("onboardingComplete"),
        F.coalesce(*([F.col("is_demo_data")] if own else []), F.col("property")["isDemoData"], F.lit(False)).alias("isDemoData"),
    )
    return heads, items


def _payload_parts(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    items = _entries(tables, False)
    return _heads(tables["households"], tables["properties"], items, F.col(S.KEY).cast("string").alias("id"), F.col("name")), items


def household_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """Aggregate documents as lines, transcripts included: what ``parse_documents`` reads back."""
    return _lines(*_document_parts(tables))


def household_payloads(tables: dict[str, DataFrame]) -> DataFrame:
    """What a client gets of a household: as the document, without transcripts."""
    return _lines(*_payload_parts(tables))


def document_pieces(tables: dict[str, DataFrame]) -> DataFrame:
    """The documents as pieces of text: in order, those of a household are one JSON object, whatever its size."""
    return _pieces(*_document_parts(tables))


def payload_pieces(tables: dict[str, DataFrame]) -> DataFrame:
    """The payloads as pieces of text: in order, those of a household are one JSON object, whatever its size."""
    return _pieces(*_payload_parts(tables))


def head_lines(lines: DataFrame) -> DataFrame:
    """The head lines alone. Who reads heads beside something else parses the lines of items once, not again for these."""
    return lines.where("list = 0")


def in_order(lines: DataFrame) -> DataFrame:
    """Lines or pieces in order over range partitions, so that a large household is spread over several."""
    keys = [c for c in (S.KEY, "list", "kind", "pos", "id") if c in lines.columns]
    return lines.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_documents(lines: DataFrame, path: str) -> None:
    """One line of a document per line of text, in order, to be read with ``spark.read.text``."""
    in_order(lines).select("json").write.mode("overwrite").text(path)
