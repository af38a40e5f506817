"""What a task holds and does of large inputs: how sources are dealt out, and what plans do more than once."""

from __future__ import annotations

import contextlib
import io
import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hearthbook.functions import scalars as X
from hearthbook.operators import calendar, extraction, relations, validation
from hearthbook.plans import derived
from hearthbook.plans.queries import QUERIES
from hearthbook.sources import addresses, documents
from tests.helpers import bill, bills, confirmed, households, slot, slots

SMALLEST = "/root/testdata/sf0.001"


def plan(frame, mode: str = "simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain(mode)
    return text.getvalue()


def test_the_day_grid_is_laid_out_after_the_sums(spark):
    known = households(spark, 1, 1, 2, None)
    due = [bill("a", confirmed(5), "2026-03-04"), bill("b", due="2026-03-04"), bill("c", confirmed(5), "2026-04-01"),
           bill("d", due="2026-03-31", household=None), bill("e", due="2026-03-05", household=9)]
    grid = calendar.calendar_grid(known, bills(spark, due), "2026-03-01")
    lines = plan(grid).splitlines()
    found = {(r.household_id, r.day.day): (r.bill_count, r.marker, r.grid_cell) for r in grid.collect()}
    assert grid.count() == len(found) == 3 * 31
    assert {k: v for k, v in found.items() if v[0]} == {(1, 4): (2, "confirmed", 9), (None, 31): (1, "other", 36)}
    explodes = [i for i, line in enumerate(lines) if "Generate explode" in line]
    sums = [i for i, line in enumerate(lines) if "Aggregate" in line]
    assert max(explodes) < min(sums)


def test_a_source_of_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", {"customer": 100}, raising=False)
    keys = [None] * 400 + [7] * 400 + list(range(200))
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64())}), tmp_path / "customer.parquet")
    rows = derived.Ledger(spark, str(tmp_path)).raw("customer")
    assert rows.columns == ["c_custkey"]
    assert sorted((r.c_custkey for r in rows.collect()), key=str) == sorted(keys, key=str)
    shares = rows.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in shares) < 300


def test_postcodes_are_normalised_once_a_use(spark):
    table = spark.createDataFrame([(1, " ls1\t2ab"), (2, "ab"), (3, "abcd"), (4, "abcde"), (5, None), (6, "")], "request_id long, postcode string")
    asked = table.select("request_id", F.concat("postcode", F.lit("")).alias("postcode"))
    normal = {r[0]: r[1] for r in asked.select("request_id", X.normalise_postcode(F.col("postcode"))).collect()}
    assert normal == {1: "LS1 2AB", 2: "AB", 3: "ABCD", 4: "AB CDE", 5: None, 6: ""}
    assert plan(asked.select(X.normalise_postcode(F.col("postcode")).alias("p"))).count("upper(") == 1


def test_whole_words_are_searched_for_plainly_first(spark):
    texts = ["a ſky, b", "by BRİTıſH GAS", "fee see", "the ee.", "i̇ DŴR CYMRU", "x", None, "SKy", "skyline sky"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = extraction.extract_bills(rows, "2026-01-01", word_boundary=True)
    names = [r[1] for r in sorted(found.select("id", found.provider.value).collect())]
    assert names == ["Sky", "British Gas", None, "EE", "Dŵr Cymru", None, None, "Sky", "Sky"]
    assert all(name.lower() in plan(found, "extended") for name in extraction.KNOWN_PROVIDERS)


@pytest.mark.parametrize("of", ["bills", "updates"])
def test_slots_are_merged_not_broadcast(spark, tmp_path, of):
    slots(spark, [slot("gas"), slot("water", household=None)]).write.parquet(str(tmp_path / "slots"))
    there = spark.read.parquet(str(tmp_path / "slots"))
    if of == "bills":
        joined = relations.service_for_bill(bills(spark, [bill("a", kind="gas"), bill("b", kind="water", household=None)]), there)
        assert sorted(joined.select("bill_id", "slot_id").collect()) == [("a", "svc-1-gas"), ("b", None)]
    else:
        updates = spark.createDataFrame([(1, "gas", "confirm", None, None)], "household_id long, kind string, action string, value string, amount_text string")
        joined = validation.check_slot_updates(updates, there)
        assert joined.first().codes == ["nothing_to_confirm"]
    assert "BroadcastHashJoin" not in plan(joined)


@pytest.mark.parametrize("name", ["household_payloads", "json_households_roundtrip"])
def test_lines_of_items_are_written_and_parsed_once(spark, name):
    assert plan(QUERIES[name](spark, SMALLEST)).count("paymentStatus, payment_status") == 1


def test_a_checksum_is_never_a_key_of_the_parser(spark):
    texts = ['{"name":"a"}', '{"mark":{"x":1},"mark":2,"name":"b"}', '{"mark":"","name":"c","bills":[{"id":"1","id":"2"}]}',
             '{"a":1}},{"end":{"mark":"0"}}]', '{"a":1}},{"end":{"mark":"', '{"a":1},"end":{"mark":"0"', '{"a":1}},{"end":{"mark":"0"}', "{", "5", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "household_id bigint, json string")
    parsed = documents.parse_documents(rows)
    assert sorted((r.household_id, r.name) for r in documents.read_households(parsed).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert [r.bill_id for r in documents.read_bills(parsed).collect()] == ["2"]
    reasons = {r.household_id: r.reason for r in documents.quarantine(parsed).collect()}
    assert reasons == {3: "not_json", 4: "not_json", 5: "not_json", 6: "not_json", 7: "not_json", 8: "not_an_object", 9: "not_json"}
    assert not re.search(r',\{", md5\(', plan(parsed, "extended"))  # as a key it fills the parser's memory of names


def test_why_a_text_is_unreadable_is_asked_for_such_texts_only(spark):
    rows = spark.createDataFrame([(1, json.dumps({"results": []}))], "household_id bigint, json string")
    for frame, name in ((documents.parse_documents(rows), "_doc"), (addresses.read_feed(rows), "_response")):
        reason = plan(frame, "extended")
        assert re.search(rf"CASE WHEN isnull\({name}#\d+\) THEN CASE WHEN coalesce", reason)
        assert not re.search(rf"isnull\({name}#\d+\) AND", reason)  # what both sides share is worked out for each row
