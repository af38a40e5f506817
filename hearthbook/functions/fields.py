"""Provenance fields as column expressions.

A field is ``struct<value, source, status, recorded_at, note>``. A null struct
means the same as a missing field, so every predicate here is null-safe and
returns true or false, never null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from hearthbook import schema as S
from hearthbook.functions import coerce

ColumnOrText = Column | str | None


def _text(value: ColumnOrText) -> Column:
    """A string column from a column, a plain string or None."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("string")


def _build(value: Column, source: ColumnOrText, status: ColumnOrText,
           recorded_at: Column | None, note: ColumnOrText) -> Column:
    stamp = F.lit(None) if recorded_at is None else recorded_at
    return F.struct(
        value.alias("value"),
        _text(source).alias("source"),
        _text(status).alias("status"),
        stamp.cast("timestamp").alias("recorded_at"),
        _text(note).alias("note"),
    )


# ---- constructors ---------------------------------------------------------


def missing(value_type: T.DataType | str, note: ColumnOrText = None) -> Column:
    return _build(F.lit(None).cast(value_type), "none", "missing", None, note)


def suggested(value: Column, source: ColumnOrText, note: ColumnOrText = None,
              recorded_at: Column | None = None) -> Column:
    """A suggested field; a null value gives a missing one (nothing to suggest)."""
    held = value.isNotNull()
    return _build(
        value,
        F.when(held, _text(source)).otherwise("none"),
        F.when(held, "suggested").otherwise("missing"),
        None if recorded_at is None else F.when(held, recorded_at),
        F.when(held, _text(note)),
    )


def confirmed(value: Column, source: ColumnOrText = "userConfirmed",
              note: ColumnOrText = None, recorded_at: Column | None = None) -> Column:
    """A confirmed field; a null value gives a missing one."""
    held = value.isNotNull()
    return _build(
        value,
        F.when(held, _text(source)).otherwise("none"),
        F.when(held, "confirmed").otherwise("missing"),
        None if recorded_at is None else F.when(held, recorded_at),
        F.when(held, _text(note)),
    )


# ---- predicates -----------------------------------------------------------


def has_value(field: Column) -> Column:
    return field["value"].isNotNull() & ~is_missing(field)


def is_missing(field: Column) -> Column:
    return F.coalesce(field["status"], F.lit("missing")) == "missing"


def is_confirmed(field: Column) -> Column:
    return field["status"].eqNullSafe("confirmed") & field["value"].isNotNull()


def needs_confirmation(field: Column) -> Column:
    return field["status"].eqNullSafe("suggested") & field["value"].isNotNull()


def is_estimate(field: Column) -> Column:
    """The source alone decides, whatever the status says."""
    return field["source"].eqNullSafe("estimate")


def is_automatic(field: Column) -> Column:
    return F.coalesce(field["source"].isin(*S.AUTOMATIC_SOURCES), F.lit(False))


def is_human_confirmed(field: Column) -> Column:
    return F.coalesce(field["source"].isin(*S.HUMAN_SOURCES), F.lit(False))


# ---- transitions ----------------------------------------------------------


def confirm(field: Column, at: Column | None = None) -> Column:
    """Promote to confirmed by the resident; without a value nothing changes."""
    stamp = field["recorded_at"] if at is None else at
    promoted = _build(field["value"], "userConfirmed", "confirmed", stamp, field["note"])
    return F.when(field["value"].isNotNull(), promoted).otherwise(field)


def rejection_note(value: Column) -> Column:
    """The note a rejected field keeps: which value the resident turned down."""
    return F.concat(F.lit("rejected: "), F.coalesce(value.cast("string"), F.lit("")))


def reject(field: Column, value_type: T.DataType | str, note: ColumnOrText = None) -> Column:
    return missing(value_type, rejection_note(field["value"]) if note is None else note)


def edited(value: Column, at: Column | None = None) -> Column:
    return confirmed(value, "userEntered", recorded_at=at)


def with_note(field: Column, note: ColumnOrText) -> Column:
    return field.withField("note", _text(note))


# ---- checks and classification --------------------------------------------


def violations(field: Column) -> Column:
    """Codes of the invariants a field breaks; an empty array means it is sound.

    A null struct reads as a missing field and breaks none.
    """
    source = F.coalesce(field["source"], F.lit("none"))
    status = F.coalesce(field["status"], F.lit("missing"))
    value = field["value"]
    return F.array_compact(
        F.array(
            F.when(~source.isin(*S.FIELD_SOURCES), "unknown_source"),
            F.when(~status.isin(*S.FIELD_STATUSES), "unknown_status"),
            F.when(value.isNull() & (status != "missing"), "status_without_value"),
            F.when(value.isNotNull() & (status == "missing"), "value_without_status"),
        )
    )


def provenance_class(field: Column) -> Column:
    """Display class, first match wins: notRecorded, estimate, suggested:<source>, source."""
    return (
        F.when(~has_value(field), "notRecorded")
        .when(is_estimate(field), "estimate")
        .when(needs_confirmation(field), F.concat(F.lit("suggested:"), field["source"]))
        .otherwise(field["source"])
    )


# ---- decoding -------------------------------------------------------------


#: Members of a stored field, as a schema.
STORED = "value: variant, note: variant, needsConfirmation: variant, source: string, status: string, recordedAt: string"


def nodes(node: Column) -> Column:
    """The members of a stored field, still undecoded: what ``decode`` works on.

    Names and stamps are read as text at once: no other JSON value has a text that
    is a known name or a timestamp.
    """
    return coerce.members(
        node, "value", "note", "needsConfirmation", texts=("source", "status", "recordedAt")
    )


def decode(stored: Column, as_value: Callable[[Column], Column]) -> Column:
    """Tolerant decode of ``nodes`` into a field.

    ``as_value`` turns the VARIANT under ``value`` into the wanted type and gives
    null where it cannot; such a value counts as absent, so the field is missing
    (``undecodable`` reports those). Unknown names fall back to none / missing. An old
    ``needsConfirmation: true`` without a status means suggested. What is not an
    object is a missing field.
    """
    value = as_value(stored["value"])
    status = coerce.enum(stored["status"], S.FIELD_STATUSES, "missing")
    source = coerce.enum(stored["source"], S.FIELD_SOURCES, "none")
    flagged = coerce.only_boolean(stored["needsConfirmation"]).eqNullSafe(F.lit(True))
    resolved = (
        F.when(value.isNull(), "missing")
        .when((status == "missing") & flagged, "suggested")
        .otherwise(status)
    )
    return _build(
        value,
        source,
        resolved,
        coerce.timestamp(stored["recordedAt"]),
        coerce.only_string(stored["note"]),
    )


def undecodable(stored: Column, as_value: Callable[[Column], Column]) -> Column:
    """True where a value is present in the document but has no readable form."""
    raw = stored["value"]
    present = raw.isNotNull() & ~F.coalesce(F.is_variant_null(raw), F.lit(True))
    return F.coalesce(present, F.lit(False)) & as_value(raw).isNull()


def from_mixed(node: Column, as_value: Callable[[Column], Column],
               default_source: str = "userEntered") -> Column:
    """A field from request input: nothing, a full field, or a bare value.

    An object with a ``status`` is a full field; anything else is a bare value,
    which the resident typed in, hence confirmed. What cannot be read is missing.
    """
    stored = nodes(node)
    value = as_value(stored["value"])
    given = _build(
        value,
        F.coalesce(stored["source"], F.lit("none")),
        F.when(value.isNull(), "missing").otherwise(stored["status"]),
        coerce.timestamp(stored["recordedAt"]),
        coerce.only_string(stored["note"]),
    )
    bare = confirmed(as_value(node), default_source)
    return F.when(stored["status"].isNotNull(), given).otherwise(bare)
