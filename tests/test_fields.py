from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, scalars as X


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


WESSEX = lambda: P.suggested(F.lit("Wessex Water"), "postcodeLookup")


def test_a_suggestion_is_not_confirmed(spark):
    field = WESSEX()
    row = spark.range(1).select(
        P.has_value(field), P.is_confirmed(field), P.needs_confirmation(field),
        P.is_automatic(field), P.is_human_confirmed(field),
    ).first()
    assert tuple(row) == (True, False, True, True, False)


def test_confirm_reject_edit(spark):
    done = _one(spark, P.confirm(WESSEX(), F.lit("2026-01-01").cast("timestamp")))
    assert (done.value, done.source, done.status) == ("Wessex Water", "userConfirmed", "confirmed")
    assert done.recorded_at == dt.datetime(2026, 1, 1)
    gone = _one(spark, P.reject(WESSEX(), "string"))
    assert (gone.value, gone.status, gone.source) == (None, "missing", "none")
    assert "Wessex Water" in gone.note
    empty = _one(spark, P.confirm(P.missing("string", "was here")))
    assert (empty.source, empty.status, empty.note) == ("none", "missing", "was here")
    typed = _one(spark, P.edited(F.lit(5)))
    assert (typed.value, typed.source, typed.status) == (5, "userEntered", "confirmed")
    assert _one(spark, P.with_note(WESSEX(), None)).note is None


def test_null_struct_reads_as_missing(spark):
    nothing = F.lit(None).cast(S.TEXT_FIELD)
    row = spark.range(1).select(
        P.has_value(nothing), P.is_confirmed(nothing), P.is_estimate(nothing), P.is_automatic(nothing)
    ).first()
    assert tuple(row) == (False, False, False, False)
    assert _one(spark, P.violations(nothing)) == []
    assert _one(spark, P.provenance_class(nothing)) == "notRecorded"


def test_violations(spark):
    base = P.confirmed(F.lit(1))
    cases = {
        (): base,
        ("unknown_source",): base.withField("source", F.lit("rumour")),
        ("unknown_status",): base.withField("status", F.lit("maybe")),
        ("status_without_value",): base.withField("value", F.lit(None).cast("int")),
        ("value_without_status",): base.withField("status", F.lit("missing")),
    }
    for codes, field in cases.items():
        assert tuple(_one(spark, P.violations(field))) == codes


def _decode(spark, text, reader=coerce.as_int):
    return _one(spark, P.decode(P.nodes(F.parse_json(F.lit(text))), reader))


def test_tolerant_decode(spark):
    full = _decode(spark, '{"value":5,"source":"estimate","status":"suggested",'
                          '"recordedAt":"2026-10-28T10:00:00.000Z","note":"n"}')
    assert tuple(full) == (5, "estimate", "suggested", dt.datetime(2026, 10, 28, 10), "n")
    assert _decode(spark, '{"value":5,"needsConfirmation":true}').status == "suggested"
    assert _decode(spark, '{"value":5,"needsConfirmation":"true"}').status == "missing"
    assert _decode(spark, '{"value":5,"status":"confirmed","needsConfirmation":true}').status == "confirmed"
    odd = _decode(spark, '{"value":"7","source":"x","status":"confirmed","recordedAt":"soon"}')
    assert tuple(odd) == (7, "none", "confirmed", None, None)
    for text in ("null", "[1]", '"5"', '{"value":null,"status":"confirmed"}', '{"value":"lots","status":"confirmed"}'):
        row = _decode(spark, text)
        assert (row.value, row.status) == (None, "missing")


def test_round_trip_of_a_date_field(spark):
    row = _decode(spark, '{"value":"2026-10-28T00:00:00.000","source":"userConfirmed","status":"confirmed"}',
                  coerce.as_date)
    assert (row.value, row.source, row.status) == (dt.date(2026, 10, 28), "userConfirmed", "confirmed")


def test_mixed_input(spark):
    def read(text):
        row = _one(spark, P.from_mixed(F.parse_json(F.lit(text)), coerce.as_int))
        return row.value, row.source, row.status

    assert read("null") == (None, "none", "missing")
    assert read("12") == (12, "userEntered", "confirmed")
    assert read('"x"') == (None, "none", "missing")
    assert read('{"value":3,"source":"estimate","status":"confirmed"}') == (3, "estimate", "confirmed")
    assert read('{"value":3}') == (None, "none", "missing")


def test_money(spark):
    cases = {
        "£92.50": 9250, "1,234": 123400, " £ 1 000.5 ": 100050, "92.": 9200, ".5": 50, "-3": -300, "1e2": 10000,
        "": None, "abc": None, "£": None, "1.2.3": None, "NaN": None, "Infinity": None, "1d": None, "1.005": 100,
        "9" * 30: None,
    }
    for text, expected in cases.items():
        assert _one(spark, X.parse_money(F.lit(text))) == expected, text
    shown = {0: "£0.00", 5: "£0.05", 123456789: "£1,234,567.89", -150: "-£1.50", None: "—"}
    for minor, expected in shown.items():
        assert _one(spark, X.format_money(F.lit(minor).cast("bigint"))) == expected


def test_monthly_equivalent(spark):
    cases = [(36000, "quarterly", 12000), (100, "weekly", 433), (6, "annually", 1), (5, "annually", 0),
             (-6, "annually", -1), (100, "oneOff", 0), (100, "sometimes", 100), (None, "weekly", 0)]
    for minor, frequency, expected in cases:
        column = X.monthly_equivalent(F.lit(minor).cast("bigint"), F.lit(frequency))
        assert _one(spark, column) == expected


def test_due_labels(spark):
    cases = {"2026-10-27": "Due today", "2026-10-28": "Due tomorrow", "2026-10-26": "1 day late",
             "2026-10-20": "7 days late", "2026-11-02": "Due in 6 days", "2026-11-03": "Due 3 Nov"}
    for due, expected in cases.items():
        label = X.relative_due_label(F.lit(due).cast("date"), F.lit("2026-10-27").cast("date"))
        assert _one(spark, label) == expected


def test_postcodes(spark):
    for text, normal, fits, prefix in [
        ("bs14dj", "BS1 4DJ", True, "BS"), (" ls1  2ab ", "LS1 2AB", False, "LS"), ("M1 1AE", "M1 1AE", True, "M"),
        ("nope", "NOPE", False, "NOPE"), ("SW1A1AA", "SW1A 1AA", True, "SW"), ("", "", False, ""),
    ]:
        assert _one(spark, X.normalise_postcode(F.lit(text))) == normal
        assert _one(spark, X.looks_like_postcode(F.lit(text))) is fits
        assert _one(spark, X.area_prefix(F.lit(text))) == prefix


def test_roles_and_masks(spark):
    for role, edit, manage, text in [("owner", True, True, "£1.00"), ("tenant", True, False, "£1.00"),
                                     ("housemate", True, False, "£1.00"), ("viewer", False, False, "••••")]:
        row = spark.range(1).select(
            X.can_edit_bills(F.lit(role)), X.can_manage_household(F.lit(role)),
            X.masked_money(F.lit(100), F.lit(role)),
        ).first()
        assert tuple(row) == (edit, manage, text)


def test_coercions(spark):
    def read(function, text):
        return _one(spark, function(F.parse_json(F.lit(text))))

    assert read(coerce.as_int, "5.9") == 5 and read(coerce.as_int, '"-7"') == -7
    assert read(coerce.as_int, "9007199254740993") == 9007199254740993
    assert read(coerce.as_int, '"5.9"') is None and read(coerce.as_int, "true") is None
    assert read(coerce.as_bool, '"yes"') is False and read(coerce.as_bool, "2") is True
    assert read(coerce.as_string, "true") == "true" and read(coerce.as_string, "[1]") == ""
    assert read(coerce.as_string_list, '{"a":1}') == []
    assert read(coerce.as_date, '"2026-02-30"') is None
    assert read(coerce.as_timestamp, '"12:00"') is None
    assert _one(spark, coerce.trim(F.lit(" \t x y ﻿\n"))) == "x y"
