"""Stored ledger tables: fields by type, tables in buckets, and addresses by a stored key."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from hearthbook import schema as S
from hearthbook.operators import commands as C, relations
from hearthbook.sources import addresses, relational
from tests.helpers import bill, bills, confirmed, ids


def _stored(spark, *texts):
    rows = [(f"b{i}", t) for i, t in enumerate(texts)]
    blank = [F.lit(None).cast("string").alias(c) for c in ("provider", "due_date")]
    return spark.createDataFrame(rows, "bill_id string, amount_minor string").select("*", *blank)


def test_stored_fields_are_read_by_what_they_hold(spark):
    table = _stored(
        spark, '{"value":"12","source":"estimate","status":"suggested"}', '{"value":12.9,"status":"confirmed"}',
        '{"value":5,"needsConfirmation":true}', '{"value":1,"value":7,"source":"rumour","status":"confirmed","note":"n"}', "nonsense", None, "[]",
        '{"value":{},"status":"confirmed"}', '{"value":3,"status":"confirmed","recordedAt":"2026-01-02T03:04:05Z"}',
    )
    found = {r.bill_id: r.amount_minor for r in relational.decode_fields(table, "bills").collect()}
    assert [(f.value, f.source, f.status) for f in found.values()] == [
        (12, "estimate", "suggested"), (12, "none", "confirmed"), (5, "none", "suggested"), (7, "none", "confirmed"),
        (None, "none", "missing"), (None, "none", "missing"), (None, "none", "missing"), (None, "none", "missing"), (3, "none", "confirmed"),
    ]
    assert found["b3"].note == "n" and found["b8"].recorded_at is not None


def test_what_stored_fields_lose_is_reported(spark):
    table = _stored(spark, '{"value":1,"source":"userEntered","status":"confirmed"}', "nonsense", None, '{"value":"lots","source":"rumour"}', '{"value":1,"recordedAt":"soon"}')
    found = {r.bill_id: (r.field, r.codes, r.text) for r in relational.unreadable_fields(table, "bills", "bill_id").collect()}
    assert found == {
        "b1": ("amount_minor", ["not_an_object"], "nonsense"),
        "b3": ("amount_minor", ["unreadable_value", "unknown_source"], '{"value":"lots","source":"rumour"}'),
        "b4": ("amount_minor", ["unreadable_time"], '{"value":1,"recordedAt":"soon"}'),
    }


def _files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_names(spark, tmp_path):
    path = str(tmp_path / "bills")
    rows = [bill(f"b{i}", confirmed(i), household=i % 200) for i in range(1000)]
    rows += [bill(f"h{i}", confirmed(i), household=777) for i in range(600)]
    relational.write_buckets(bills(spark, rows), path, "bills", buckets=32)
    before = _files(path)
    batch = spark.createDataFrame([("b3", 3, "paid", 1), ("b203", 3, "paid", 2), ("b7", 7, "scheduled", 3)], "bill_id string, household_id bigint, payment_status string, seq bigint")
    deletes = spark.createDataFrame([("b403", 3)], "bill_id string, household_id bigint")
    touched = batch.select(S.KEY).union(deletes.select(S.KEY))

    def change(state):
        return C.change_bills(state, patches=batch.drop(S.KEY), deletes=deletes.select("bill_id"))

    named = relational.change_buckets(spark, path, "bills", touched, change, buckets=32)
    after = _files(path)
    assert 1 <= len(named) <= 2 and {f.split("/")[0] for f in before ^ after} == {f"bucket={n}" for n in named}
    table = relational.read_buckets(spark, path, "bills")
    states = {r.bill_id: r.payment_status for r in table.collect()}
    assert len(states) == 1599 and "b403" not in states
    assert (states["b3"], states["b203"], states["b7"], states["b603"]) == ("paid", "paid", "scheduled", "unknown")
    assert table.columns == bills(spark, []).columns
    again = sorted(map(repr, table.collect()))
    relational.change_buckets(spark, path, "bills", touched, change, buckets=32)
    assert sorted(map(repr, relational.read_buckets(spark, path, "bills").collect())) == again


def test_a_bucket_can_become_empty(spark, tmp_path):
    path = str(tmp_path / "bills")
    relational.write_buckets(bills(spark, [bill("a", confirmed(1), household=1), bill("b", confirmed(2), household=2)]), path, "bills", buckets=64)
    one = spark.createDataFrame([("a", 1)], "bill_id string, household_id bigint")
    relational.change_buckets(spark, path, "bills", one, lambda state: C.change_bills(state, deletes=one.select("bill_id")), buckets=64)
    assert ids(relational.read_buckets(spark, path, "bills"), "bill_id") == ["b"]
    assert relational.change_buckets(spark, path, "bills", one.limit(0), lambda state: state, buckets=64) == []
    assert ids(relational.read_buckets(spark, path, "bills"), "bill_id") == ["b"]


def test_addresses_are_searched_where_they_lie(spark, tmp_path):
    rows = [(f"{i} Mill Lane", "Leeds", "ls1  2ab" if i % 2 else f"M{i % 9 + 1}1AE", f"u{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "line1 string, town string, postcode string, uprn string")
    addresses.store(frame, "stored_addresses", 4, str(tmp_path / "addresses"))
    stored = spark.table("stored_addresses")
    requests = spark.createDataFrame([(1, "LS1 2AB"), (2, "m21ae"), (3, "nonsense"), (4, "ZE1 0AA")], "request_id bigint, postcode string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relations.search_addresses(requests, stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # One exchange, of the requests; the addresses are joined by a plain column of their file.
        assert plan.count("Exchange hashpartitioning") == 1 and "regexp" not in plan.split("FileScan")[0].split("Exchange")[0]
        by_request = found.groupBy("request_id").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE stored_addresses")
    plain = relations.search_addresses(requests, frame)
    assert sorted(map(tuple, by_request)) == sorted((r, n) for r, n in map(tuple, plain.groupBy("request_id").count().collect()))


def test_feed_keeps_every_response(spark):
    good = {"results": [{"DPA": {"UPRN": "1"}}, {"LPI": {}}]}
    rows = [("A", json.dumps(good)), ("B", "oops"), ("C", None), ("D", '{"results":[]}'), ("E", "[1]"), ("F", '{"results":{}}')]
    feed = addresses.read_feed(spark.createDataFrame(rows, "postcode string, json string"))
    aside = addresses.feed_quarantine(feed).collect()
    whole = {r.postcode for r in aside if r.position is None}
    read = set(ids(feed.where("reason IS NULL"), "postcode"))
    assert whole == {"B", "C", "E", "F"} and read == {"A", "D"}
    assert [(r.postcode, r.position, r.reason) for r in aside if r.position is not None] == [("A", 1, "no_address")]
    assert ids(addresses.parse_feed(feed), "uprn") == ["1"]
