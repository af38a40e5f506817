from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from hearthbook import schema as S
from hearthbook.functions import fields as P
from hearthbook.operators import commands as C, validation as V
from tests.helpers import MISSING, bill, bills, confirmed, day, households, ids, slot, slots, suggested

STAMP = dt.datetime(2026, 1, 1)
COMMANDS = "household_id bigint, kind string, seq bigint, action string, value string, ts timestamp"


def _replay(provider, commands):
    """The same commands one by one, for comparison."""
    value, source, status, note = provider
    for _, action, new in sorted(commands):
        if action == "set" and (new or "").strip():
            value, source, status, note = new.strip(), "userEntered", "confirmed", None
        elif action == "reject":
            value, source, status, note = None, "none", "missing", f"rejected: {value or ''}"
        elif action == "confirm" and value is not None:
            source, status = "userConfirmed", "confirmed"
    return value, source, status, note


def test_provider_answers_match_a_replay(spark):
    rng = random.Random(7)
    starts = [MISSING, suggested("Guess", "postcodeLookup"), confirmed("Own", "userEntered")]
    rows, commands, expected = [], [], {}
    for household in range(120):
        start = starts[household % 3]
        rows.append(slot("gas", start, household=household))
        mine = [
            (seq, rng.choice(["set", "reject", "confirm", "not_sure"]), rng.choice([None, " ", f" New {seq} "]))
            for seq in rng.sample(range(100), rng.randint(0, 6))
        ]
        commands += [(household, "gas", seq, action, value, STAMP) for seq, action, value in mine]
        expected[household] = _replay((start[0], start[1], start[2], start[4]), mine)
    rng.shuffle(commands)
    frame = C.answer_providers(slots(spark, rows), spark.createDataFrame(commands, COMMANDS))
    found = {
        r.household_id: (r.provider.value, r.provider.source, r.provider.status, r.provider.note)
        for r in frame.collect()
    }
    assert found == expected


def test_one_slot_with_very_many_commands(spark):
    many = spark.range(200_000).select(
        F.lit(1).cast("bigint").alias("household_id"), F.lit("gas").alias("kind"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "set").when(F.col("id") % 3 == 1, "reject").otherwise("confirm").alias("action"),
        F.col("id").cast("string").alias("value"), F.lit(STAMP).alias("ts"),
    )
    row = C.answer_providers(slots(spark, [slot("gas")]), many).first().provider
    # 199999 is a reject after set 199998.
    assert (row.value, row.status, row.note) == (None, "missing", "rejected: 199998")


def test_edits_are_independent_and_last_one_wins(spark):
    edits = spark.createDataFrame(
        [(1, "gas", 1, "A1", 100, None, None), (1, "gas", 2, None, -5, "weekly", "2026-02-03"),
         (1, "gas", 3, " ", None, None, "never")],
        "household_id bigint, kind string, seq bigint, account_number string, amount_minor bigint, "
        "frequency string, next_due_date string")
    row = C.edit_slots(slots(spark, [slot("gas", due="2026-01-01")]), edits).first()
    assert (row.account_number.status, row.amount_minor.value, row.frequency) == ("missing", 100, "weekly")
    assert row.next_due_date.status == "missing"


def test_forms_keep_what_is_left_blank(spark):
    forms = spark.createDataFrame(
        [(1, "gas", 1, " ", "", "0", "weekly", None)],
        "household_id bigint, kind string, seq bigint, provider string, account_number string, amount_text string, "
        "frequency string, next_due_date date")
    before = slot("gas", confirmed("Own"), confirmed(5), "2026-01-01", account=confirmed("A"))
    after = C.apply_slot_forms(slots(spark, [before]), forms).first()
    assert after == slots(spark, [before]).first()


def test_adding_and_removing_services(spark):
    changes = spark.createDataFrame(
        [(1, "gas", 1, "add"), (1, "water", 1, "remove"), (1, "water", 2, "add"), (1, "tvLicence", 3, "add"),
         (1, "broadband", 4, "add"), (1, "broadband", 5, "remove")],
        "household_id bigint, kind string, seq bigint, action string")
    rows = [slot("gas", confirmed("Own")), slot("water", confirmed("Old"))]
    found = {r.kind: r for r in C.change_slots(slots(spark, rows), changes).collect()}
    assert set(found) == {"gas", "water", "tvLicence"}
    assert found["gas"].provider.value == "Own" and found["water"].provider.value is None
    assert found["tvLicence"].lookup_keys == ["tv_licence"]


def test_slots_follow_the_latest_confirmed_bill(spark):
    rows = [
        bill("a", confirmed(100), "2026-01-01", kind="gas", provider=confirmed("Old"), updated="2026-01-01"),
        bill("b", confirmed(200), None, kind="gas", frequency="quarterly", updated="2026-02-01"),
        bill("c", confirmed(300, "estimate"), "2026-03-01", kind="gas", updated="2026-03-01"),
        bill("d", suggested(400), "2026-04-01", kind="gas", updated="2026-04-01"),
    ]
    row = C.sync_slots(slots(spark, [slot("gas")]), bills(spark, rows)).first()
    assert (row.provider.value, row.amount_minor.value, row.frequency) == ("Old", 200, "quarterly")
    assert row.next_due_date.value == dt.date(2026, 1, 1) and row.amount_minor.source == "userEntered"


def test_bill_changes(spark):
    table = bills(spark, [bill("a", confirmed(1)), bill("b", confirmed(2), status="paid"), bill("c", confirmed(3))])
    paid = C.paid_patches(spark.createDataFrame([("a", 1, True), ("b", 2, False)], "bill_id string, seq bigint, paid boolean"))
    priced = spark.range(1).select(
        F.lit("a").alias("bill_id"), F.lit(3).cast("bigint").alias("seq"),
        P.confirmed(F.lit(9).cast("bigint"), "userEntered").alias("amount_minor"))
    deletes = spark.createDataFrame([("c",)], "bill_id string")
    changed = C.change_bills(table, bills(spark, [bill("n", confirmed(4))]),
                             paid.unionByName(priced, allowMissingColumns=True), deletes)
    found = {r.bill_id: (r.amount_minor.value, r.payment_status) for r in changed.collect()}
    assert found == {"a": (9, "paid"), "b": (2, "unknown"), "n": (4, "unknown")}


def test_reminders_from_bills(spark):
    rows = [bill("far", confirmed(1), "2026-12-10"), bill("near", confirmed(1), "2026-10-28"),
            bill("none", confirmed(1)), bill("paid", confirmed(1), "2026-12-10", status="paid")]
    made = {r.bill_id: r.due_at for r in C.reminders_from_bills(bills(spark, rows), "2026-10-27").collect()}
    assert made == {"far": dt.date(2026, 12, 7), "near": dt.date(2026, 10, 27)}


def test_create_households(spark):
    schema = ("household_id bigint, name string, line1 string, line2 string, town string, postcode string, uprn string, "
              "tenure string, services array<string>, resident_name string, address_source string, is_demo_data boolean")
    requests = spark.createDataFrame(
        [(1, None, " 1 High St ", None, "Leeds", "ls12ab", None, "owning", ["gas", "water", "gas"], " ", None, None),
         (2, "B", "2", None, "Leeds", "x", None, "owning", [], "Ann", None, True),
         (3, "C", " ", None, "Leeds", "x", None, "squat", ["solar"], "Ann", None, True)], schema)
    accepted, rejected = V.split(requests, V.household_rules())
    assert rejected.first().codes == ["line1_required", "unknown_tenure", "unknown_service"]
    made = C.create_households(accepted)
    kinds = {k: [r.kind for r in made["service_slots"].where(f"household_id = {k}").orderBy("pos").collect()] for k in (1, 2)}
    assert kinds == {1: ["gas", "water"], 2: ["electricity", "gas", "water", "councilTax"]}
    home = made["properties"].where("household_id = 1").first()
    assert (home.line1, home.postcode, home.address_source) == ("1 High St", "LS1 2AB", "Manual entry")
    assert ids(made["members"].orderBy("household_id"), "name") == ["You", "Ann"]
    assert V.duplicate_slots(made["service_slots"]).count() == 0


def test_removing_the_current_member(spark):
    members = spark.createDataFrame(
        [("a", 1, "A", None, "owner", True, True, 0), ("b", 1, "B", None, "tenant", True, False, 1)], S.MEMBERS)
    homes, left = C.change_members(
        households(spark, 1, current="a"), members,
        invites=spark.createDataFrame([("c", 1, " C ", None, "viewer", 5)],
                                      "member_id string, household_id bigint, name string, email string, role string, seq bigint"),
        removals=spark.createDataFrame([("a",)], "member_id string"))
    assert homes.first().current_member_id == "b"
    assert ids(left.orderBy("pos"), "name") == ["B", "C"]
    assert not left.where("member_id = 'c'").first().has_accepted_invite


def test_reset_empties_every_table(spark):
    tables = {"bills": bills(spark, [bill("a", household=1), bill("b", household=2)]), "households": households(spark, 1, 2)}
    left = C.reset_households(tables, households(spark, 1))
    assert ids(left["bills"], "bill_id") == ["b"] and ids(left["households"], "household_id") == [2]


def test_bill_validation(spark):
    rows = [bill("ok", confirmed(1), kind="gas"), bill("kind", confirmed(1), kind="solar"), bill("none"),
            bill("zero", confirmed(0)), bill("estimate", suggested(5, "estimate"))]
    accepted, rejected = V.split(bills(spark, rows), V.bill_rules())
    assert sorted(ids(accepted, "bill_id")) == ["estimate", "ok"]
    assert {r.bill_id: r.codes for r in rejected.collect()} == {
        "kind": ["unknown_kind"], "none": ["amount_required"], "zero": ["amount_not_positive"]}
    assert accepted.where("bill_id = 'estimate'").first().amount_minor.source == "estimate"


def test_permissions(spark):
    members = spark.createDataFrame(
        [("o", 1, "O", None, "owner", True, True, 0), ("v", 1, "V", None, "viewer", True, False, 1)], S.MEMBERS)
    asked = spark.createDataFrame(
        [(1, "o", "reset"), (1, "v", "reset"), (1, "v", "set_paid"), (1, "x", "set_paid"), (1, "v", "not_sure")],
        "household_id bigint, member_id string, action string")
    found = sorted((r.member_id, r.action, tuple(r.codes)) for r in V.check_permissions(asked, members).collect())
    assert found == [("o", "reset", ()), ("v", "not_sure", ()), ("v", "reset", ("may_not_manage",)),
                     ("v", "set_paid", ("may_not_edit_bills",)), ("x", "set_paid", ("may_not_edit_bills",))]


def test_helpers_read_days():
    assert day("2026-01-01") == dt.date(2026, 1, 1)


def test_a_newer_answer_is_not_overwritten_by_an_older_bill(spark):
    typed = slots(spark, [slot("gas", confirmed("Own", "userEntered"))]).withColumn(
        "provider", F.col("provider").withField("recorded_at", F.lit(STAMP)))
    older = bill("a", confirmed(100), kind="gas", provider=confirmed("Old"), updated="2025-12-31")
    newer = bill("b", confirmed(200), kind="gas", provider=confirmed("New"), updated="2026-01-02")
    row = C.sync_slots(typed, bills(spark, [older])).first()
    assert (row.provider.value, row.amount_minor.value) == ("Own", 100)
    assert row.amount_minor.recorded_at == dt.datetime(2025, 12, 31)
    assert C.sync_slots(typed, bills(spark, [older, newer])).first().provider.value == "New"


def test_edits_say_when_they_were_made(spark):
    edits = spark.createDataFrame(
        [(1, "gas", 1, "A1", 100, None, None, STAMP), (1, "gas", 2, " ", None, None, None, STAMP)],
        "household_id bigint, kind string, seq bigint, account_number string, amount_minor bigint, "
        "frequency string, next_due_date string, ts timestamp")
    row = C.edit_slots(slots(spark, [slot("gas")]), edits).first()
    assert (row.amount_minor.recorded_at, row.account_number.recorded_at) == (STAMP, None)


def test_a_batch_of_bill_changes_can_be_repeated(spark):
    table = bills(spark, [bill("a", confirmed(1))])
    wanted = bills(spark, [bill("a", confirmed(7)), bill("n", confirmed(4)), bill("n", confirmed(5))])
    inserts = wanted.withColumn("seq", F.col("amount_minor.value"))
    once = C.change_bills(table, inserts)
    assert sorted((r.bill_id, r.amount_minor.value) for r in once.collect()) == [("a", 1), ("n", 5)]
    assert once.columns == table.columns
    assert C.change_bills(once, inserts).exceptAll(once).isEmpty()


def test_a_blank_note_clears_the_note(spark):
    notes = "bill_id string, seq bigint, notes string"
    noted = C.change_bills(bills(spark, [bill("a", confirmed(1))]), patches=spark.createDataFrame([("a", 1, " first ")], notes))
    assert noted.first().notes == "first"
    kept = C.change_bills(noted, patches=spark.createDataFrame([("a", 2, None)], notes))
    assert kept.first().notes == "first"
    assert C.change_bills(kept, patches=spark.createDataFrame([("a", 3, " ")], notes)).first().notes is None


def test_unknown_actions_are_reported(spark):
    members = spark.createDataFrame([("v", 1, "V", None, "viewer", True, True, 0)], S.MEMBERS)
    asked = spark.createDataFrame([(1, "v", "add"), (1, "v", "borrow"), (1, "v", None)], "household_id bigint, member_id string, action string")
    found = {r.action: r.codes for r in V.check_permissions(asked, members).collect()}
    assert found == {"add": [], "borrow": ["unknown_action"], None: ["unknown_action"]}
