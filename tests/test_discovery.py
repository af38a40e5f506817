from __future__ import annotations

from hearthbook import schema as S
from hearthbook.operators import discovery, relations
from hearthbook.sources import dimensions
from tests.helpers import MISSING, bill, bills, confirmed, households, ids, slot, slots, suggested


def _properties(spark, *postcodes):
    rows = [(f"p{i}", i, "1", None, "T", code, None, "owning", "x", False) for i, code in enumerate(postcodes, 1)]
    return spark.createDataFrame(rows, S.PROPERTIES)


def _suggestions(spark, *postcodes):
    return discovery.discover(_properties(spark, *postcodes), dimensions.sample_area_providers(spark))


def test_regional_kinds_are_suggested_and_energy_is_unknown(spark):
    found = {r.kind: r for r in _suggestions(spark, "bs1 4dj").collect()}
    assert set(found) == {"water", "wastewater", "councilTax", "electricity", "gas"}
    assert found["water"].provider.status == "suggested" and found["water"].provider.source == "postcodeLookup"
    assert (found["water"].confidence, found["wastewater"].confidence) == ("areaCertain", "areaOnly")
    assert found["gas"].provider.value is None and found["gas"].confidence == "unknown"


def test_unknown_area_gives_only_energy_rows(spark):
    assert sorted(ids(_suggestions(spark, "EH1 1AA"), "kind")) == ["electricity", "gas"]


def test_the_residents_answer_always_wins(spark):
    rows = [
        slot("water", confirmed("Mine", "userEntered")),
        slot("wastewater", suggested("Typed", "userEntered")),
        slot("councilTax", suggested("Old guess"), keys=["find_council"]),
        slot("gas", (None, "none", "missing", None, "rejected: X")),
        slot("broadband", MISSING),
    ]
    table = slots(spark, rows)
    suggestions = _suggestions(spark, "BS1 4DJ")
    merged = discovery.apply_suggestions(table, suggestions)
    found = {r.kind: r for r in merged.collect()}
    assert found["water"].provider.value == "Mine" and found["wastewater"].provider.value == "Typed"
    assert found["councilTax"].provider.value == "Bristol City Council (sample)"
    assert found["councilTax"].lookup_keys == ["find_council", "council_tax"]
    assert found["gas"].provider.note == "rejected: X" and not found["gas"].applied
    assert [k for k, r in found.items() if r.applied] == ["councilTax"]
    again = discovery.apply_suggestions(merged.drop("applied"), suggestions).drop("applied")
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.drop("applied").collect()))
    assert discovery.applied_counts(merged).first().applied_count == 1


def test_rejected_suggestion_comes_back(spark):
    table = slots(spark, [slot("water", (None, "none", "missing", None, "rejected: Wessex"))])
    assert discovery.apply_suggestions(table, _suggestions(spark, "BS1 4DJ")).first().applied


def test_kinds(spark):
    table = slots(spark, [slot("water"), slot("gas")])
    missing = discovery.missing_kinds(households(spark, 1, 2), table)
    assert missing.where("household_id = 1").count() == 7 and missing.where("household_id = 2").count() == 9
    assert ids(discovery.kinds_still_needed(table, _suggestions(spark, "BS1 4DJ")), "kind") == ["gas"]
    assert ids(discovery.without_property(households(spark, 1, 2), _properties(spark, "x")), "household_id") == [2]


def test_current_member_falls_back(spark):
    members = spark.createDataFrame(
        [("a", 1, "A", None, "viewer", True, False, 0), ("b", 1, "B", None, "tenant", True, False, 1)], S.MEMBERS)

    def current(member_id):
        row = relations.current_members(households(spark, 1, current=member_id), members).first()
        return row.member_id, row.role

    assert current("b") == ("b", "tenant") and current("gone") == ("a", "viewer") and current(None) == ("a", "viewer")
    alone = relations.current_members(households(spark, 2), members).first()
    assert (alone.member_id, alone.role) == (None, "owner")


def test_links_keep_order_and_drop_unknown_keys(spark):
    table = slots(spark, [slot("councilTax", keys=["council_tax", "retired", "find_council"])])
    linked = relations.slot_links(table, dimensions.lookup_links(spark))
    assert ids(linked, "key") == ["council_tax", "find_council"]


def test_first_slot_of_a_kind_is_used(spark):
    twice = slots(spark, [slot("gas"), ("svc-0", *slot("gas")[1:])])
    linked = relations.service_for_bill(bills(spark, [bill("b", kind="gas")]), twice)
    assert ids(linked, "slot_id") == ["svc-0"]
