from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hearthbook.operators import extraction as X


def _read(spark, text, **options):
    frame = spark.createDataFrame([(text, options.pop("kind", None))], "text string, kind string")
    return X.extract_bills(frame, "2026-01-01", **options).collect()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("28/10/2026", "2026-10-28"),
        ("01/02/2026", "2026-02-01"),
        ("28 October 2026", "2026-10-28"),
        ("28th of Oct 2026", "2026-10-28"),
        ("October 28, 2026", "2026-10-28"),
        ("2026-10-28", "2026-10-28"),
        ("31/02/2026", None),
        ("not a date", None),
        ("28/10/26", "2026-10-28"),
        ("28.10.2026", "2026-10-28"),
        ("1 sept 26", "2026-09-01"),
        ("1 septem 2026", None),
        ("05/06/20", "2120-06-05"),
        ("05/06/21", "2021-06-05"),
        ("5 june 20", "2020-06-05"),
        ("30/13/2026", None),
        (" 28 October 2026 ", "2026-10-28"),
        ("", None),
    ],
)
def test_flexible_dates(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string")
    found = X.with_date(frame, "t", "d", "2026-01-01").first()["d"]
    assert found == (None if expected is None else dt.date.fromisoformat(expected))


def test_full_bill(spark):
    row = _read(spark, "Octopus Energy Ltd\r\nYour electricity bill\r\nAmount due: £92.50\r\n"
                       "Payment due date: 28/10/2026\r\nMonthly direct debit\r\n")
    assert row.provider.value == "Octopus Energy"
    assert row.amount_minor.value == 9250
    assert row.due_date.value == dt.date(2026, 10, 28)
    assert (row.frequency, row.detected_kind, row.warnings) == ("monthly", "electricity", [])


def test_every_value_is_only_a_suggestion(spark):
    row = _read(spark, "Thames Water\nTotal amount due: £180.00\nDue 12 November 2026")
    for field in (row.provider, row.amount_minor, row.due_date):
        assert (field.status, field.source) == ("suggested", "billExtraction")


def test_labelled_total_beats_larger_amount(spark):
    row = _read(spark, "British Gas\nBalance brought forward: £400.00\nTotal amount due: £92.50\n"
                       "Payment due date: 28/10/2026")
    assert row.amount_minor.value == 9250


def test_first_amount_of_the_best_label_wins(spark):
    row = _read(spark, "Total: £1\nPlease pay £2 or £3\nAmount due: £4\nAmount due £5")
    assert row.amount_minor.value == 400


def test_several_unlabelled_amounts_warn(spark):
    row = _read(spark, "Scottish Power\nUsage charge £40.00\nStanding charge £5.00\nVAT £2.25")
    assert row.amount_minor.value == 4000 and "several_amounts" in row.warnings
    assert "single_unlabelled_amount" in _read(spark, "Charge £1,234.5 only").warnings


def test_no_date_is_invented(spark):
    row = _read(spark, "Thames Water\nTotal amount due: £180.00\nAccount 12345")
    assert row.amount_minor.value == 18000 and row.due_date.status == "missing"
    assert row.warnings == ["missing_date"]


def test_unreadable_date_warns_and_loose_pattern_helps(spark):
    row = _read(spark, "Pay by 31/02/2026 at once. It was due: 05/03/2026")
    assert "unreadable_date" in row.warnings and row.due_date.value == dt.date(2026, 3, 5)


def test_council_tax_quarterly(spark):
    row = _read(spark, "Bristol City Council\nCouncil tax instalment\nAmount due: £145.00\n"
                       "Payment due: 01/11/2026\nQuarterly")
    assert (row.detected_kind, row.frequency) == ("councilTax", "quarterly")


def test_hint_wins(spark):
    text = "Demo Fibre Ltd\nAmount due: £32.00\nDue date: 30/10/2026 water"
    assert _read(spark, text, kind="gas", hint="kind").detected_kind == "gas"
    assert _read(spark, text, hint="kind").detected_kind == "water"


def test_provider_rules(spark):
    assert _read(spark, "E.ON Next and E.ON").provider.value == "E.ON Next"
    assert _read(spark, "dŴR cymru").provider.value == "Dŵr Cymru"
    assert _read(spark, "a late fee").provider.value == "EE"
    assert _read(spark, "a late fee", word_boundary=True).provider.value is None
    assert _read(spark, "with EE mobile", word_boundary=True).provider.value == "EE"
    labelled = _read(spark, "Provider: Lumen Ltd")
    assert labelled.provider.value == "Lumen" and "provider_from_label" in labelled.warnings
    assert _read(spark, "Provider: XY").provider.value is None
    assert _read(spark, "provider: Lumen").provider.value is None


def test_money_with_no_break_space_and_whole_text(spark):
    long = "x" * 200_000 + "\nTotal due £  7\nTotal due £ 92.50"
    assert _read(spark, long).amount_minor.value == 9250


def test_extraction_needs_no_shuffle(spark):
    frame = spark.createDataFrame([("x",)], "text string")
    plan = X.extract_bills(frame, "2026-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_short_texts_are_set_apart(spark):
    frame = spark.createDataFrame([("  a short text  ",), ("a text that is long enough",), (None,)], "text string")
    assert X.readable(frame).count() == 1 and X.too_short(frame).count() == 2


def test_seeded_search_finds_what_the_whole_pattern_finds(spark):
    rng = random.Random(7)
    words = ["due", "Due date", "due on", "DUE BY", "payment due", "please pay by", "pay by", "instalment due", "next payment", "Next Payment due",
             "residue", "dues", "undue", "pay", "by", ":", " ", "  ", "\n", "\t", "-", "of", "the", "5", "31/12/2026", "1.2.26", "2026-10-28", "28th of October 2026",
             "March 5, 2026", "5 March 26", "sept", "99", "£", "é", "İ", "x" * 30, "next", "payment", " " * 45]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    frame = spark.createDataFrame([(t,) for t in texts], "_text string").withColumn("_lower", F.lower("_text"))
    pairs = frame.select("_text", X._due_text().alias("seeded"), F.regexp_extract("_text", X.DUE_DATE, 1).alias("whole")).collect()
    assert [r for r in pairs if r.seeded != r.whole] == []
    assert sum(r.whole != "" for r in pairs) > 1000


def test_a_derived_text_is_made_once(spark, capsys):
    """Leaving out short texts doesn't make a text that is derived from other columns a second time."""
    text = F.when(F.col("id") > 1, F.concat(F.lit("Made Total £"), F.col("id").cast("string"), F.lit(" due 01/02/2026"))).when(F.col("id") > 0, "short")
    kept = X.readable(spark.range(4).select("id", text.alias("text")))
    assert kept.columns == ["id", "text"] and sorted(r["id"] for r in kept.collect()) == [2, 3]
    X.extract_bills(kept, "2026-01-01").select("id", "warnings").explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("Made Total") == 1


def test_a_line_is_lowered_once_for_all_labels(spark):
    assert str(X._money_lines(F.col("text"))).count("lower(") == 1
