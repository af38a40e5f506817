from __future__ import annotations

import json
import random

from hearthbook import schema as S
from hearthbook.sources import addresses, documents as D, relational
from tests.helpers import bill, bills, confirmed, ids, slot, slots, suggested


def _parse(spark, *texts):
    rows = [(i + 1, t if isinstance(t, str) or t is None else json.dumps(t)) for i, t in enumerate(texts)]
    return D.parse_documents(spark.createDataFrame(rows, "household_id bigint, json string"))


def test_malformed_parts_are_tolerated(spark):
    parsed = _parse(spark, {
        "property": {"id": "p1"},
        "services": [{"id": "s1", "kind": "not_a_real_kind"}, "nonsense", {"id": ""}, {"kind": "gas"}],
        "bills": "not a list",
    })
    home = D.read_properties(parsed).first()
    assert (home.line1, home.tenure, home.address_source) == ("", "other", "Manual entry")
    assert [(r.slot_id, r.kind, r.frequency) for r in D.read_slots(parsed).collect()] == [("s1", "other", "monthly")]
    assert D.read_bills(parsed).count() == 0 and D.quarantine(parsed).count() == 0


def test_quarantine_keeps_every_bad_document(spark):
    parsed = _parse(spark, "{", "[1]", "null", '{"version":2}', "", '{"a":1}}', '{"a":1}],[{"b":2}', '{"a":1},"end":1',
                    '{"a":1} 5', None, '{"version":1}', "  {} \n")
    found = {r.household_id: r.reason for r in D.quarantine(parsed).collect()}
    assert found == {1: "not_json", 2: "not_an_object", 3: "not_an_object", 4: "unknown_version", 5: "not_json",
                     6: "not_json", 7: "not_json", 8: "not_json", 9: "not_json", 10: "not_json"}
    assert sorted(ids(D.read_households(parsed), "household_id")) == [11, 12]


def test_household_id_from_the_document(spark):
    raw = spark.createDataFrame([('{"householdId":7}',), ("{}",)], "json string")
    parsed = D.parse_documents(raw, key=None)
    assert ids(D.read_households(parsed), "household_id") == [7]
    assert ids(D.quarantine(parsed), "reason") == ["no_household_id"]


def test_unreadable_values_are_missing_and_reported(spark):
    parsed = _parse(spark, {"bills": [{"id": "b", "amountMinor": {"value": {}, "status": "confirmed"},
                                       "dueDate": {"value": "soon", "status": "confirmed"}}]})
    row = D.read_bills(parsed).first()
    assert (row.amount_minor.status, row.due_date.status) == ("missing", "missing")
    assert sorted(ids(D.unreadable_values(parsed), "unreadable")) == ["amountMinor", "dueDate"]


def _tables(spark):
    member = [(f"m{i}", 1, f"Member {i}", None, "viewer", True, False, i) for i in range(12)]
    text = "long text, \"quoted\" £\n" * 50
    return {
        "households": spark.createDataFrame([(1, "A", "p1", "m1", True), (2, "B", None, None, False)], S.HOUSEHOLDS),
        "properties": spark.createDataFrame(
            [("p1", 1, '1 "Test" Street', None, "Bristol", "BS1 4DJ", "123", "renting", "feed", False)], S.PROPERTIES),
        "service_slots": slots(spark, [
            slot("water", suggested("Wessex Water", "postcodeLookup"), confirmed(9000), keys=["a", "b"]),
            slot("gas", household=2)]),
        "bills": bills(spark, [bill(f"b{i}", confirmed(i), "2026-01-02", period_start="2025-12-01") for i in range(40)]),
        "documents": spark.createDataFrame(
            [(f"d{i}", 1, "policy", f"T{i}", None, None, None, None, None, text, None, "b1", None) for i in range(5)],
            S.DOCUMENTS),
        "reminders": spark.createDataFrame([("r", 2, "payment", "Pay", None, None, None, True)], S.REMINDERS),
        "members": spark.createDataFrame(member, S.MEMBERS),
    }


def _rows(frame, *without):
    return sorted(map(repr, frame.select(*[c for c in frame.columns if c not in without]).collect()))


def test_round_trip_is_the_identity(spark):
    tables = _tables(spark)
    written = D.household_documents(tables)
    parsed = D.parse_documents(written)
    for items in (None, D.tagged_items(parsed)):
        back = D.household_tables(parsed, items)
        for name, table in tables.items():
            columns = [c for c in table.columns if c != "created_at"]
            assert _rows(table.select(columns)) == _rows(back[name].select(columns)), name
    assert {r.property_id for r in back["bills"].collect()} == {"p1"}
    assert [(r.property_id) for r in back["reminders"].collect()] == [None]


def test_ten_cycles_give_the_same_rows(spark):
    rng = random.Random(4)
    names = [f"Member {i} \"é\" " + "x" * rng.randrange(30) for i in range(4100)]
    tables = {name: spark.createDataFrame([], ddl) for name, ddl in {
        "households": S.HOUSEHOLDS, "properties": S.PROPERTIES, "service_slots": S.SERVICE_SLOTS, "bills": S.BILLS,
        "documents": S.DOCUMENTS, "reminders": S.REMINDERS, "members": S.MEMBERS}.items()}
    tables["households"] = spark.createDataFrame([(1, "A", None, "m1", True)], S.HOUSEHOLDS)
    tables["members"] = spark.createDataFrame(
        [(f"m{i}", 1, n, None, "viewer", True, False, (i * 7) % 5000 - 9) for i, n in enumerate(names)], S.MEMBERS)
    first = _rows(tables["members"].select("member_id", "name", "pos"))
    for _ in range(10):
        lines = D.household_documents(tables).select("household_id", "json").collect()
        parsed = D.parse_documents(spark.createDataFrame(lines, "household_id bigint, json string"))
        tables = {**tables, **{k: D.READERS[k](parsed) for k in ("households", "members")}}
        assert _rows(tables["members"].select("member_id", "name", "pos")) == first
    assert D.quarantine(parsed).count() == 0


def test_lines_are_small_and_ordered_documents(spark):
    lines = D.in_order(D.household_documents(_tables(spark))).select("household_id", "list", "pos", "id", "json").collect()
    keys = [(r.household_id, r.list, r.pos if r.pos is not None else -(1 << 62), r.id) for r in lines]
    assert keys == sorted(keys) and len(lines) == 2 + 2 + 40 + 5 + 1 + 12
    sizes = [sum(len(json.loads(r.json).get(n, [])) for n in D.LISTS) for r in lines]
    assert sorted(set(sizes)) == [0, 1]


def test_pieces_in_order_are_one_object_per_household(spark):
    tables = _tables(spark)
    lone = spark.createDataFrame([("r9", 9, "payment", "Stray", None, None, None, False)], S.REMINDERS)
    tables["reminders"] = tables["reminders"].union(lone)
    texts = {}
    for r in D.in_order(D.document_pieces(tables)).collect():
        texts[r.household_id] = texts.get(r.household_id, "") + r.piece
    found = {k: json.loads(v) for k, v in texts.items()}
    assert set(found) == {1, 2, 9} and found[9]["property"] is None
    assert [m["id"] for m in found[1]["members"]] == [f"m{i}" for i in range(12)]
    assert {k: len(v["bills"]) for k, v in found.items()} == {1: 40, 2: 0, 9: 0}
    assert found[1]["bills"][0]["propertyId"] == "p1" and found[1]["isDemoData"] is False
    parsed = D.parse_documents(spark.createDataFrame([(v,) for v in texts.values()], "json string"), key=None)
    back = D.household_tables(parsed)
    for name in ("bills", "service_slots", "members", "documents"):
        columns = [c for c in tables[name].columns if c != "created_at"]
        assert _rows(tables[name].select(columns)) == _rows(back[name].select(columns)), name
    texts = {}
    for r in D.in_order(D.payload_pieces(tables)).collect():
        texts[r.household_id] = texts.get(r.household_id, "") + r.piece
    assert json.loads(texts[1])["name"] == "A" and "extractedText" not in texts[1]


def test_each_text_is_parsed_once(spark):
    parsed = D.parse_documents(spark.createDataFrame([(1, "{}")], "household_id bigint, json string"))
    for frame in (D.tagged_items(parsed), D.read_bills(parsed), D.read_households(parsed)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(ArrayType(MapType") == 2  # the second one for texts that the first can't read


def test_repeated_keys_are_read(spark):
    text = ('{"name":"old","name":"new","bills":[{"id":"x","id":"b1","kind":"gas","amountMinor":{"value":1,"value":5,"status":"confirmed"}},'
            '"nonsense",{"id":"b2","notes":"n"}],"members":[{"id":"m"}],"property":{"id":"p","id":"q"}}')
    parsed = _parse(spark, text)
    assert D.quarantine(parsed).count() == 0
    head = D.read_households(parsed).first()
    assert (head.name, head.property_id) == ("new", "q")
    bills = sorted((r.bill_id, r.kind, r.amount_minor.value, r.notes) for r in D.read_bills(parsed).collect())
    assert bills == [("b1", "gas", 5, None), ("b2", "other", None, "n")]
    assert ids(D.read_members(parsed), "member_id") == ["m"]


def test_demo_data_of_a_document(spark):
    parsed = _parse(spark, {"isDemoData": True}, {"property": {"id": "p", "isDemoData": True}}, {})
    assert sorted((r.household_id, r.is_demo_data) for r in D.read_households(parsed).collect()) == [(1, True), (2, False), (3, False)]
    assert [r.is_demo_data for r in D.read_properties(parsed).collect()] == [True]


def test_text_cannot_pretend_to_be_one_value(spark):
    tricks = ['{"a":1}},{"b":{}', '{"a":1}}]', '{"a":1}},{"x":{}}]', '{"a":1},"doc":{"a":2}', '{"a":1}],[{"b":2}', '{"a":1}},{"', "{}{}"]
    found = {r.reason for r in D.quarantine(_parse(spark, *tricks)).collect()}
    assert found == {"not_json"} and D.read_households(_parse(spark, *tricks)).count() == 0


def test_payload_hides_transcripts(spark):
    lines = [json.loads(r.json) for r in D.household_payloads(_tables(spark)).where("household_id = 1").collect()]
    head = next(line for line in lines if "itemLine" not in line)
    assert head["name"] == "A" and head["property"]["postcode"] == "BS1 4DJ"
    documents = [line["documents"][0] for line in lines if "documents" in line]
    assert len(documents) == 5 and all("extractedText" not in d for d in documents)


def test_files_round_trip(spark, tmp_path):
    tables = _tables(spark)
    D.write_documents(D.household_documents(tables), str(tmp_path / "docs"))
    raw = spark.read.text(str(tmp_path / "docs")).withColumnRenamed("value", "json")
    assert D.read_bills(D.parse_documents(raw, key=None)).count() == 40
    relational.write_table(tables["bills"], str(tmp_path / "bills"), "bills")
    stored = relational.read_table(spark, str(tmp_path / "bills"), "bills")
    assert _rows(stored) == _rows(tables["bills"])


def test_transcripts_only_on_request(spark):
    documents = _tables(spark)["documents"]
    assert "extracted_text" not in relational.list_documents(documents).columns
    assert "extracted_text" in relational.list_documents(documents, include_text=True).columns


def test_address_feed(spark):
    response = {"results": [
        {"DPA": {"ADDRESS": "1 High St, Leeds", "POST_TOWN": " LEEDS ", "POSTCODE": "LS1 2AB", "UPRN": "9"}},
        {"DPA": {"BUILDING_NAME": "", "BUILDING_NUMBER": "7", "THOROUGHFARE_NAME": "Mill Lane"}},
        {"DPA": {}}, {"LPI": {"UPRN": "1"}}, {"DPA": {"OTHER": "x"}},
    ]}
    rows = spark.createDataFrame([("LS9 9ZZ", json.dumps(response)), ("M1 1AE", "oops")], "postcode string, json string")
    found = [tuple(r) for r in addresses.parse_feed(rows).collect()]
    assert found == [
        ("1 High St", None, "LEEDS", "LS1 2AB", "9"),
        ("7 Mill Lane", None, "", "LS9 9ZZ", None),
        ("Address", None, "", "LS9 9ZZ", None),
    ]
