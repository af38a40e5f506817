"""Tolerant coercions: bad input becomes null or a default, never an error.

Functions that take a ``node`` work on VARIANT columns (parsed JSON); the others
work on plain strings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# White space that trimming removes: the Unicode set plus the byte-order mark.
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

_SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
_STAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([ T][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?( ?([zZ]|[+-][0-9]{2}(:?[0-9]{2})?))?)?$"
)


# ---- strings --------------------------------------------------------------


def trim(text: Column) -> Column:
    """Strip all white space from both ends (plain SQL trim only strips blanks)."""
    return F.btrim(text, F.lit(_SPACE_CHARACTERS))


def non_blank(text: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trim(text), F.lit(""))


def to_int(text: Column) -> Column:
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("bigint"))


def to_double(text: Column) -> Column:
    """Finite decimal text to double, null otherwise."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def date(text: Column) -> Column:
    """The first ten characters as an ISO day, null when they are not one."""
    return F.when(text.rlike(_DAY), F.substring(text, 1, 10).try_cast("date"))


def timestamp(text: Column) -> Column:
    """ISO timestamp, null when unreadable. Text without an offset is UTC."""
    return F.when(text.rlike(_STAMP), text.try_cast("timestamp"))


def names(values: Sequence[str]) -> Column:
    """A constant array of names."""
    return F.expr("array(" + ", ".join(f"'{value}'" for value in values) + ")")


def lookup(values: Mapping[str, str | int]) -> Column:
    """A constant map from names to texts or numbers."""
    return F.expr("map(" + ", ".join(f"'{k}', {v!r}" for k, v in values.items()) + ")")


def enum(name: Column, allowed: Sequence[str], default: str) -> Column:
    """The name itself when it is a known one, else the default."""
    return F.when(F.array_contains(names(allowed), name), name).otherwise(F.lit(default))


# ---- VARIANT nodes --------------------------------------------------------


def _type(node: Column) -> Column:
    return F.schema_of_variant(node)


def is_object(node: Column) -> Column:
    return F.coalesce(_type(node).startswith("OBJECT"), F.lit(False))


def is_array(node: Column) -> Column:
    return F.coalesce(_type(node).startswith("ARRAY"), F.lit(False))


def _is_string(node: Column) -> Column:
    return _type(node) == "STRING"


def _is_boolean(node: Column) -> Column:
    return _type(node) == "BOOLEAN"


def _is_number(node: Column) -> Column:
    name = _type(node)
    return name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")


def child(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def members(node: Column, *names: str, texts: Sequence[str] = ()) -> Column:
    """The named members of an object as a struct; null for other nodes.

    Members are VARIANTs, those in ``texts`` strings (JSON text for anything else).
    """
    inner = ", ".join([f"{name}: variant" for name in names] + [f"{name}: string" for name in texts])
    return F.try_variant_get(node, "$", f"struct<{inner}>")


def only_string(node: Column) -> Column:
    """The text of a JSON string, null for any other node."""
    return F.when(_is_string(node), F.try_variant_get(node, "$", "string"))


def only_boolean(node: Column) -> Column:
    return F.when(_is_boolean(node), F.try_variant_get(node, "$", "boolean"))


def plain_string(node: Column, path: str) -> Column:
    """The text at ``path`` when it is a JSON string, else null."""
    return only_string(child(node, path))


def as_string(node: Column, fallback: str = "") -> Column:
    """Strings as they are, numbers and booleans as text, anything else the fallback."""
    readable = _is_string(node) | _is_number(node) | _is_boolean(node)
    return F.when(readable, F.try_variant_get(node, "$", "string")).otherwise(F.lit(fallback))


def as_string_or_null(node: Column) -> Column:
    return F.nullif(as_string(node), F.lit(""))


def as_trimmed_string(node: Column) -> Column:
    """Request text: trimmed, blank means absent."""
    return non_blank(F.try_variant_get(node, "$", "string"))


def as_int(node: Column) -> Column:
    """Whole numbers as they are, fractions truncated, digit strings parsed."""
    text = F.try_variant_get(node, "$", "string")
    whole = F.coalesce(text.try_cast("bigint"), F.try_variant_get(node, "$", "double").try_cast("bigint"))
    return F.when(_is_number(node), whole).when(_is_string(node), to_int(text))


def as_double(node: Column) -> Column:
    text = F.try_variant_get(node, "$", "string")
    return (
        F.when(_is_number(node), F.try_variant_get(node, "$", "double"))
        .when(_is_string(node), to_double(text))
    )


def as_bool(node: Column, fallback: bool = False) -> Column:
    """Booleans as they are, text only if it is 'true', numbers if not zero."""
    return (
        F.when(_is_boolean(node), F.try_variant_get(node, "$", "boolean"))
        .when(_is_string(node), F.try_variant_get(node, "$", "string") == "true")
        .when(_is_number(node), F.try_variant_get(node, "$", "double") != 0)
        .otherwise(F.lit(fallback))
    )


def as_date(node: Column) -> Column:
    return F.when(_is_string(node), date(F.try_variant_get(node, "$", "string")))


def as_timestamp(node: Column) -> Column:
    return F.when(_is_string(node), timestamp(F.try_variant_get(node, "$", "string")))


def as_list(node: Column) -> Column:
    """Array of VARIANT items; anything that is not a list gives an empty array."""
    empty = F.from_json(F.lit("[]"), "array<variant>")
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), empty)


def as_object_list(node: Column) -> Column:
    """The items of a list that are objects; the others are skipped."""
    return F.filter(as_list(node), is_object)


def as_string_list(node: Column) -> Column:
    """The items of a list as text, empty ones left out."""
    texts = F.transform(as_list(node), lambda item: as_string(item))
    return F.filter(texts, lambda text: text != "")


# ---- JSON texts -------------------------------------------------------------


def whole_object(text: Column, ddl: str) -> Column:
    """A JSON object as a struct, null for any text that isn't one object and nothing else.

    The parser stops after the first value. So the text is put between a key and an element that holds
    what it cannot foresee (its own checksum): only if both are found as they were written has it been
    one value. The checksum is a value there, not a key: parsers keep the keys they have met, and a new one with each text
    would fill that memory. Of repeated keys the last one counts; members of another type than wanted are null.
    The struct has the member ``mark`` after those of ``ddl``.
    """
    mark = F.md5(text)
    wrapped = F.concat(F.lit('[{"doc":'), text, F.lit('},{"end":{"mark":"'), mark, F.lit('"}}]'))

    def checked(found: Column) -> Column:
        one, two = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        ended = (F.map_keys(two) == F.array(F.lit("end"))) & (F.try_element_at(two, F.lit("end"))["mark"] == mark)
        alone = (F.size(found) == 2) & (F.map_keys(one) == F.array(F.lit("doc"))) & ended
        return F.when(F.coalesce(alone, F.lit(False)), F.try_element_at(one, F.lit("doc")))

    marked = ddl.removesuffix(">") + ", mark: string>"
    parsed = F.from_json(wrapped, f"array<map<string, {marked}>>")
    return F.get(F.transform(F.array(parsed), checked), F.lit(0))  # bound to a name, so that it is parsed once


def some_value(text: Column) -> Column:
    """True for sound JSON of any kind."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    ended = F.get_json_object(F.concat(F.lit('{"doc":'), text, F.lit(',"end":1}')), "$.end")
    alone = child(listed, "$[0]").isNotNull() & child(listed, "$[1]").isNull()
    return F.coalesce(alone & (ended == "1"), F.lit(False))


def unreadable_text(text: Column) -> Column:
    """Why a text is not one JSON object.

    To be used as a value of ``F.when``. In a condition Spark would parse each text for it, also where the answer isn't
    wanted, as it works out before all else what a row's conditions share.
    """
    return F.when(some_value(text), "not_an_object").otherwise("not_json")
