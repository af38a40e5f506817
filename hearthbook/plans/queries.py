"""The registered queries: each takes (spark, sf_dir) and returns a flat DataFrame.

All of them read whole tables. Dates come out as ISO text, fields as plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, rules as R, scalars as X
from hearthbook.operators import (
    calendar,
    commands as C,
    discovery,
    extraction,
    listings,
    relations,
    spending,
    summary,
    validation as V,
)
from hearthbook.plans.derived import AS_OF, MONTH, REMINDER_AS_OF, SUGGESTED_AT, TEXT_AS_OF, Ledger
from hearthbook.sources import addresses, dimensions, documents, relational

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Ledger(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def iso(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def parts(name: str, *which: str) -> list[Column]:
    """Members of a field as flat columns; dates as text."""
    out = []
    for part in which or ("value", "source", "status"):
        column = F.col(name)[part]
        if part == "value" and name.endswith("date"):
            column = iso(column)
        out.append(column.alias(f"{name}_{part}"))
    return out


def recorded(*names: str) -> list[Column]:
    """When fields were recorded, as text."""
    return [F.date_format(F.col(n)["recorded_at"], "yyyy-MM-dd HH:mm:ss").alias(f"{n}_recorded_at") for n in names]


def codes(name: str = "codes") -> Column:
    return F.concat_ws(",", F.col(name)).alias(name)


def with_codes(table: DataFrame, *keys: str | Column) -> DataFrame:
    return table.select(*keys, codes())


# ---- summary, spending, calendar -------------------------------------------


@query
def household_summary(t: Ledger) -> DataFrame:
    return summary.household_summary(t.households, t.slots, t.bills, AS_OF)


@query
def household_summary_confirmed_overdue(t: Ledger) -> DataFrame:
    return summary.household_summary(
        t.households, t.slots, t.bills, AS_OF, require_confirmed_overdue=True
    )


@query
def monthly_spend(t: Ledger) -> DataFrame:
    return spending.monthly_spend(t.bills).withColumn("month", iso("month"))


@query
def month_bar_ratio(t: Ledger) -> DataFrame:
    bars = spending.month_bars(t.bills)
    return bars.select("household_id", iso("month").alias("month"), "total_minor", "bar_ratio")


@query
def spending_totals(t: Ledger) -> DataFrame:
    return spending.spending_totals(t.bills)


@query
def spend_by_kind_share(t: Ledger) -> DataFrame:
    return spending.spend_by_kind(t.bills)


@query
def calendar_month(t: Ledger) -> DataFrame:
    return calendar.calendar_days(t.bills, MONTH).withColumn("day", iso("day"))


@query
def calendar_month_totals(t: Ledger) -> DataFrame:
    return calendar.calendar_totals(t.bills, MONTH)


@query
def calendar_day_bills(t: Ledger) -> DataFrame:
    listed = calendar.day_bills(t.bills, MONTH)
    return listed.select("household_id", "bill_id", iso(F.col("due_date")["value"]).alias("day"))


@query
def calendar_spine(t: Ledger) -> DataFrame:
    return calendar.calendar_grid(t.households, t.bills, MONTH).withColumn("day", iso("day"))


@query
def due_next_7_days(t: Ledger) -> DataFrame:
    return calendar.due_next(t.bills, AS_OF).select(
        "bill_id", "household_id", iso(F.col("due_date")["value"]).alias("due")
    )


# ---- bill rules and lists ---------------------------------------------------


@query
def bill_states(t: Ledger) -> DataFrame:
    return t.bills.select(
        "bill_id",
        R.is_paid().alias("paid"),
        R.is_estimate().alias("estimate"),
        R.has_confirmed_amount().alias("confirmed_amount"),
        R.is_actionable().alias("actionable"),
        R.is_overdue(AS_OF).alias("overdue"),
        R.is_due_within(AS_OF, 30).alias("due_in_30"),
        R.bill_state(AS_OF).alias("state"),
    )


@query
def bill_sections(t: Ledger) -> DataFrame:
    return listings.section_counts(t.bills, AS_OF)


@query
def bill_filter_to_pay(t: Ledger) -> DataFrame:
    return listings.filtered_bills(t.bills, "toPay").select("household_id", "bill_id")


@query
def bill_filter_needs_details(t: Ledger) -> DataFrame:
    return listings.filtered_bills(t.bills, "needsDetails").select("household_id", "bill_id")


@query
def bill_filter_paid(t: Ledger) -> DataFrame:
    return listings.filtered_bills(t.bills, "paid").select("household_id", "bill_id")


@query
def bill_tiles(t: Ledger) -> DataFrame:
    return listings.bill_tiles(t.bills, AS_OF)


@query
def bills_by_date(t: Ledger) -> DataFrame:
    return listings.bills_by_date(t.bills).select(
        "household_id", "bill_id", *parts("due_date", "value")
    )


@query
def upcoming_top5(t: Ledger) -> DataFrame:
    top = listings.upcoming_top(t.bills, 5)
    return top.select(
        "household_id",
        "bill_id",
        *parts("due_date", "value"),
        F.col("position").cast("bigint").alias("position"),
    )


@query
def needs_details_list(t: Ledger) -> DataFrame:
    listed = listings.needs_details(t.bills)
    return listed.select(
        "household_id", "bill_id", X.kind_ordinal(F.col("kind")).cast("bigint").alias("kind_ordinal")
    )


@query
def estimates_list(t: Ledger) -> DataFrame:
    return listings.estimates(t.bills).select(
        "household_id", "bill_id", *parts("due_date", "value"), *parts("amount_minor", "value")
    )


@query
def reminders_open(t: Ledger) -> DataFrame:
    listed = listings.open_reminders(t.reminders, REMINDER_AS_OF)
    return listed.select("household_id", "reminder_id", iso("due_at").alias("due_at"), "overdue")


@query
def reminders_done(t: Ledger) -> DataFrame:
    return listings.done_reminders(t.reminders).select("household_id", "reminder_id", "kind")


# ---- services ---------------------------------------------------------------


@query
def service_readiness(t: Ledger) -> DataFrame:
    return listings.slot_actions(t.slots)


@query
def services_outstanding(t: Ledger) -> DataFrame:
    return summary.services_outstanding(t.households, t.slots)


@query
def household_stages(t: Ledger) -> DataFrame:
    return summary.household_stages(t.households, t.properties)


@query
def household_counts(t: Ledger) -> DataFrame:
    return summary.household_counts(t.households, t.members, t.documents)


@query
def setup_order(t: Ledger) -> DataFrame:
    return listings.setup_order(t.slots).select("household_id", "kind", "setup_rank")


@query
def monthly_equivalents(t: Ledger) -> DataFrame:
    amount = F.col("amount_minor")["value"]
    return t.slots.select(
        "slot_id",
        X.per_year(F.col("frequency")).cast("bigint").alias("per_year"),
        X.monthly_equivalent(amount, F.col("frequency")).alias("monthly_minor"),
        X.monthly_equivalent(-amount, F.col("frequency")).alias("monthly_refund_minor"),
    )


# ---- fields -----------------------------------------------------------------


@query
def field_states(t: Ledger) -> DataFrame:
    field = F.col("amount_minor")
    return t.bills.select(
        "bill_id",
        P.has_value(field).alias("has_value"),
        P.is_confirmed(field).alias("is_confirmed"),
        P.needs_confirmation(field).alias("needs_confirmation"),
        P.is_automatic(field).alias("is_automatic"),
        P.is_human_confirmed(field).alias("is_human_confirmed"),
        P.provenance_class(field).alias("provenance"),
    )


@query
def field_transitions(t: Ledger) -> DataFrame:
    field = F.col("provider")
    moved = t.slots.select(
        "slot_id",
        P.confirm(field).alias("confirmed"),
        P.reject(field, "string").alias("rejected"),
        P.edited(F.concat(F.lit("My "), F.col("kind"))).alias("edited"),
        P.with_note(field, "seen").alias("noted"),
        P.suggested(field["value"], "officialLookup", "from register").alias("offered"),
    )
    names = ("confirmed", "rejected", "edited", "noted", "offered")
    return moved.select(
        "slot_id", *[c for n in names for c in parts(n, "value", "source", "status", "note")]
    )


@query
def mixed_field_input(t: Ledger) -> DataFrame:
    """Request values in every form: none, bare number or text, full field, junk."""
    key = F.col("o_orderkey")
    minor = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    text = (
        F.when(key % 6 == 0, "null")
        .when(key % 6 == 1, minor)
        .when(key % 6 == 2, F.concat(F.lit('"'), minor, F.lit('"')))
        .when(
            key % 6 == 3,
            F.concat(F.lit('{"value":'), minor, F.lit(',"source":"estimate","status":"suggested"}')),
        )
        .when(key % 6 == 4, F.lit('{"value":null,"source":"none","status":"missing"}'))
        .otherwise(F.lit('"a lot"'))
    )
    rows = t.raw("orders").select("o_orderkey", F.parse_json(text).alias("node"))
    return rows.select(
        "o_orderkey", P.from_mixed(F.col("node"), coerce.as_int).alias("amount_minor")
    ).select("o_orderkey", *parts("amount_minor"))


@query
def field_violations(t: Ledger) -> DataFrame:
    """Invariant checks over fields that were damaged on purpose."""
    key = F.substring_index("bill_id", "-", -1).cast("bigint")
    amount = F.col("amount_minor")
    damaged = (
        F.when(key % 4 == 0, amount.withField("status", F.lit("missing")))
        .when(key % 4 == 1, amount.withField("value", F.lit(None).cast("bigint")))
        .when(key % 4 == 2, amount.withField("source", F.lit("rumour")))
        .otherwise(amount)
    )
    return t.bills.select("bill_id", F.concat_ws(",", P.violations(damaged)).alias("codes"))


# ---- scalars ----------------------------------------------------------------


@query
def money_parsing(t: Ledger) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    key = F.col("o_orderkey")
    typed = (
        F.when(key % 7 == 0, "")
        .when(key % 7 == 1, F.concat(F.lit("£"), price))
        .when(key % 7 == 2, F.concat(F.lit(" £ 1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5 ")))
        .when(key % 7 == 3, F.concat((key % 50).cast("string"), F.lit(".")))
        .when(key % 7 == 4, F.concat(F.lit("-"), price))
        .when(key % 7 == 5, F.concat(F.lit("about "), price))
        .otherwise(F.concat((key * 1000).cast("string"), F.lit(".005")))
    )
    rows = t.raw("orders").select("o_orderkey", typed.alias("typed"))
    checked = V.check(rows, V.typed_amount_rules("typed"))
    return checked.select("o_orderkey", X.parse_money(F.col("typed")).alias("minor"), codes())


@query
def money_formatting(t: Ledger) -> DataFrame:
    minor = F.round(F.col("c_acctbal") * 100).cast("bigint")
    shown = F.when(F.col("c_custkey") % 10 != 0, minor * F.pow(F.lit(10), F.col("c_custkey") % 4).cast("bigint"))
    return t.raw("customer").select(
        "c_custkey",
        X.format_money(shown).alias("with_pence"),
        X.format_money(shown, with_pence=False, symbol="").alias("whole"),
    )


@query
def due_labels(t: Ledger) -> DataFrame:
    due = F.col("due_date")["value"]
    return t.bills.where(due.isNotNull()).select(
        "bill_id",
        X.days_between(F.lit(AS_OF).cast("date"), due).cast("bigint").alias("days"),
        X.relative_due_label(due, F.lit(AS_OF).cast("date")).alias("label"),
        *[X.format_date(due, style).alias(style) for style in X.DATE_FORMATS],
    )


@query
def postcodes(t: Ledger) -> DataFrame:
    text = F.col("postcode")
    return t.properties.select(
        "property_id",
        X.normalise_postcode(text).alias("normalised"),
        X.looks_like_postcode(text).alias("well_formed"),
        X.outward_code(text).alias("outward"),
        X.area_prefix(text).alias("prefix"),
    )


@query
def address_lines(t: Ledger) -> DataFrame:
    full = X.display_address(F.col("line1"), F.col("line2"), F.col("town"), F.col("postcode"))
    return t.properties.select(
        "property_id",
        full.alias("display_address"),
        X.short_address(F.col("line1"), F.col("postcode")).alias("short_address"),
    )


@query
def tolerant_coercions(t: Ledger) -> DataFrame:
    """Every coercion over JSON values of every type, built from the events."""
    key = F.col("event_id")
    number = (key % 1000).cast("string")
    quote = F.lit('"')
    text = (
        F.when(key % 9 == 0, number)
        .when(key % 9 == 1, F.concat(number, F.lit(".75")))
        .when(key % 9 == 2, F.concat(quote, number, quote))
        .when(key % 9 == 3, F.lit("true"))
        .when(key % 9 == 4, F.lit('"true"'))
        .when(key % 9 == 5, F.lit("null"))
        .when(key % 9 == 6, F.concat(F.lit('{"k":'), number, F.lit("}")))
        .when(key % 9 == 7, F.concat(F.lit('["a",'), number, F.lit(',"",null,true]')))
        .otherwise(F.concat(quote, F.col("ts").cast("date").cast("string"), F.lit('T10:20:30Z"')))
    )
    node = F.col("node")
    rows = t.raw("events").select("event_id", F.parse_json(text).alias("node"))
    return rows.select(
        "event_id",
        coerce.as_string(node).alias("as_string"),
        coerce.as_int(node).alias("as_int"),
        coerce.as_double(node).alias("as_double"),
        coerce.as_bool(node).alias("as_bool"),
        iso(coerce.as_date(node)).alias("as_date"),
        F.date_format(
            F.to_utc_timestamp(coerce.as_timestamp(node), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"
        ).alias("as_timestamp"),
        coerce.is_object(node).alias("is_map"),
        F.concat_ws("|", coerce.as_string_list(node)).alias("as_string_list"),
    )


@query
def enum_fallbacks(t: Ledger) -> DataFrame:
    name = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(
        F.element_at(
            F.array(*map(F.lit, ("gas", "weekly", "paid", "owning", "viewer", "policy", "payment"))),
            (F.col("event_id") % 7 + 1).cast("int"),
        )
    )
    rows = t.raw("events").select("event_id", name.alias("name"))
    name = F.col("name")
    return rows.select(
        "event_id",
        X.service_kind(name).alias("kind"),
        X.frequency(name).alias("frequency"),
        X.payment_status(name).alias("payment_status"),
        X.tenure(name).alias("tenure"),
        X.role(name).alias("role"),
        X.document_kind(name).alias("document_kind"),
        X.reminder_kind(name).alias("reminder_kind"),
    )


# ---- discovery and relations -------------------------------------------------


def _suggestions(t: Ledger) -> DataFrame:
    return discovery.discover(t.properties, dimensions.sample_area_providers(t.spark), _suggested_at())


def _suggested_at() -> Column:
    return F.lit(SUGGESTED_AT).cast("timestamp")


@query
def provider_discovery(t: Ledger) -> DataFrame:
    return _suggestions(t).select(
        "household_id",
        "kind",
        *parts("provider"),
        *recorded("provider"),
        "confidence",
        F.array_join("lookup_keys", ",").alias("lookup_keys"),
    )


@query
def apply_suggestions(t: Ledger) -> DataFrame:
    merged = discovery.apply_suggestions(t.slots, _suggestions(t))
    return merged.select(
        "slot_id",
        *parts("provider"),
        *recorded("provider"),
        F.array_join("lookup_keys", ",").alias("lookup_keys"),
        "applied",
    )


def _areas_by_supplier(t: Ledger) -> DataFrame:
    return t.flat("areas_by_supplier").withColumn("lookup_keys", F.array("lookup_key"))


@query
def ambiguous_areas(t: Ledger) -> DataFrame:
    return discovery.ambiguous_areas(_areas_by_supplier(t))


@query
def provider_discovery_several(t: Ledger) -> DataFrame:
    """Discovery where some areas have several providers for a kind: there nothing is certain."""
    found = discovery.discover(t.properties, _areas_by_supplier(t), _suggested_at())
    return found.select(
        "household_id", "kind", *parts("provider"), *recorded("provider"), "confidence",
        F.array_join("lookup_keys", ",").alias("lookup_keys"),
    )


@query
def applied_suggestion_counts(t: Ledger) -> DataFrame:
    return discovery.applied_counts(discovery.apply_suggestions(t.slots, _suggestions(t)))


@query
def missing_kinds(t: Ledger) -> DataFrame:
    return discovery.missing_kinds(t.households, t.slots)


@query
def kinds_still_needed(t: Ledger) -> DataFrame:
    return discovery.kinds_still_needed(t.slots, _suggestions(t))


@query
def households_without_property(t: Ledger) -> DataFrame:
    return discovery.without_property(t.households, t.properties)


@query
def address_search(t: Ledger) -> DataFrame:
    found = relations.search_addresses(t.flat("address_requests").drop("uprn"), t.flat("addresses"))
    return found.select("request_id", "postcode", "line1", "town", "uprn")


@query
def address_unmatched(t: Ledger) -> DataFrame:
    return relations.unmatched_requests(t.flat("address_requests"), t.flat("addresses"))


@query
def address_by_uprn(t: Ledger) -> DataFrame:
    found = relations.addresses_by_uprn(t.flat("address_requests"), t.flat("addresses"))
    return found.select("request_id", "uprn", "line1", "postcode")


@query
def slot_links(t: Ledger) -> DataFrame:
    linked = relations.slot_links(t.slots, dimensions.lookup_links(t.spark))
    return linked.select(
        "slot_id", F.col("pos").cast("bigint").alias("pos"), "key", "title", "operator", "url"
    )


@query
def service_for_bill(t: Ledger) -> DataFrame:
    return relations.service_for_bill(t.bills, t.slots)


@query
def bill_documents(t: Ledger) -> DataFrame:
    return relations.bill_documents(t.bills, t.documents)


@query
def broken_links(t: Ledger) -> DataFrame:
    return relations.broken_links(t.bills, t.documents)


@query
def current_members(t: Ledger) -> DataFrame:
    return relations.role_permissions(relations.current_members(t.households, t.members))


@query
def role_masked_bills(t: Ledger) -> DataFrame:
    return relations.masked_bills(t.bills, relations.current_members(t.households, t.members))


@query
def requested_services(t: Ledger) -> DataFrame:
    rows = relations.requested_services(t.household_requests)
    return rows.select(
        "household_id",
        F.col("pos").cast("bigint").alias("pos"),
        "kind",
        F.array_join("unknown", ",").alias("unknown"),
    )


# ---- text extraction ---------------------------------------------------------


def _extracted(t: Ledger) -> DataFrame:
    return extraction.extract_bills(extraction.readable(t.bill_texts), TEXT_AS_OF, at=_suggested_at())


@query
def bill_text_lines(t: Ledger) -> DataFrame:
    lines = F.posexplode(extraction.bill_lines(F.col("text"))).alias("pos", "line")
    exploded = t.bill_texts.select("document_id", lines)
    return exploded.select("document_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query
def extract_provider(t: Ledger) -> DataFrame:
    return _extracted(t).select("document_id", *parts("provider", "value", "status", "note"), *recorded("provider"))


@query
def extract_amount(t: Ledger) -> DataFrame:
    return _extracted(t).select("document_id", *parts("amount_minor", "value", "status", "note"), *recorded("amount_minor"))


@query
def extract_due_date(t: Ledger) -> DataFrame:
    return _extracted(t).select("document_id", *parts("due_date", "value", "status", "note"), *recorded("due_date"))


@query
def extract_kind_frequency(t: Ledger) -> DataFrame:
    return _extracted(t).select("document_id", "detected_kind", "frequency")


@query
def extract_provider_whole_words(t: Ledger) -> DataFrame:
    """Provider names that stand alone in free prose, where short ones are parts of many words."""
    found = extraction.extract_bills(t.raw("documents").select("doc_id", "text"), TEXT_AS_OF, word_boundary=True)
    return found.select("doc_id", *parts("provider", "value", "note"))


@query
def extract_kind_with_hint(t: Ledger) -> DataFrame:
    """Kinds where the resident has said for some texts what they are about."""
    hinted = extraction.readable(t.bill_texts).withColumn("said", F.when(F.col("order_key") % 3 == 0, "broadband"))
    return extraction.extract_bills(hinted, TEXT_AS_OF, hint="said").select("document_id", "detected_kind")


@query
def extract_warnings(t: Ledger) -> DataFrame:
    found = _extracted(t)
    return found.select("document_id", codes("warnings"), extraction.found_count().cast("bigint").alias("fields"))


@query
def extract_rejects(t: Ledger) -> DataFrame:
    return extraction.too_short(t.bill_texts).select("document_id")


@query
def extraction_coverage(t: Ledger) -> DataFrame:
    return extraction.coverage(_extracted(t).withColumn("bucket", F.col("household_id") % 10), "bucket")


@query
def extract_document_corpus(t: Ledger) -> DataFrame:
    """The extraction over free prose: hardly any text should yield a bill."""
    found = extraction.extract_bills(t.raw("documents").select("doc_id", "text"), TEXT_AS_OF)
    return found.select(
        "doc_id",
        *parts("provider", "value"),
        *parts("amount_minor", "value"),
        *parts("due_date", "value"),
        "detected_kind",
        "frequency",
        codes("warnings"),
    )


def _decisions(t: Ledger) -> DataFrame:
    """Two decisions a text, a day apart; those without a time have not been made yet."""
    key = F.col("order_key")
    earlier = t.bill_texts.select(
        "document_id", F.lit("water").alias("kind"), F.lit("Earlier").alias("provider"),
        F.lit("£1").alias("amount_text"), F.lit("2026-04-04").cast("date").alias("due_date"),
        F.lit("weekly").alias("frequency"), F.when(key % 4 == 0, F.lit("2026-01-01").cast("timestamp")).alias("decided_at"),
    )
    return earlier.unionByName(_last_decisions(t))


def _last_decisions(t: Ledger) -> DataFrame:
    key = F.col("order_key")
    return t.bill_texts.select(
        "document_id",
        F.when(key % 4 == 0, "gas").alias("kind"),
        F.when(key % 6 == 0, " Chosen Ltd ").alias("provider"),
        F.when(key % 10 == 0, "£12.34").when(key % 10 == 2, "unclear").alias("amount_text"),
        F.when(key % 14 == 0, F.lit("2026-05-05").cast("date")).alias("due_date"),
        F.lit(None).cast("string").alias("frequency"),
        F.when(key % 2 == 0, F.lit("2026-01-02").cast("timestamp")).alias("decided_at"),
    )


@query
def accepted_bill_texts(t: Ledger) -> DataFrame:
    return extraction.accept_extracted(_extracted(t), _decisions(t))["bills"].select(
        "document_id", "bill_id", "kind", *parts("provider"), *parts("amount_minor"),
        *parts("due_date"), "frequency", F.concat(X.kind_label(F.col("kind")), F.lit(" bill")).alias("title"),
    )


@query
def accepted_slot_updates(t: Ledger) -> DataFrame:
    """Slots once the accepted bill texts have been carried over to them."""
    saved = extraction.accept_extracted(_extracted(t), _decisions(t))["bills"]
    synced = C.sync_slots(t.slots, saved)
    return synced.select(
        "slot_id", *parts("provider"), *parts("amount_minor"), *parts("next_due_date"), "frequency"
    )


@query
def incomplete_bill_texts(t: Ledger) -> DataFrame:
    return extraction.accept_extracted(_extracted(t), _decisions(t))["incomplete"]


# ---- state changes -----------------------------------------------------------


def _created(t: Ledger) -> dict[str, DataFrame]:
    accepted, _ = V.split(t.household_requests, V.household_rules())
    return C.create_households(accepted)


@query
def create_households(t: Ledger) -> DataFrame:
    made = _created(t)
    homes = made["properties"].drop("is_demo_data")
    owners = made["members"].select("household_id", F.col("name").alias("owner_name"), "role")
    named = made["households"].select("household_id", "name", "onboarding_complete")
    return named.join(homes, "household_id").join(owners, "household_id")


@query
def create_household_slots(t: Ledger) -> DataFrame:
    return _created(t)["service_slots"].select(
        "slot_id", "household_id", "kind", F.col("pos").cast("bigint").alias("pos"),
        F.array_join("lookup_keys", ",").alias("lookup_keys"), *parts("provider", "status"),
    )


@query
def slot_commands(t: Ledger) -> DataFrame:
    answered = C.answer_providers(t.slots, t.commands)
    return answered.select("slot_id", *parts("provider", "value", "source", "status", "note"), *recorded("provider"))


def _slot_edits(t: Ledger) -> DataFrame:
    seq = F.col("seq")
    return t.commands.select(
        "household_id", "kind", "seq",
        F.when(seq % 4 == 0, F.concat(F.lit(" N"), seq.cast("string")))
        .when(seq % 12 == 1, " ").alias("account_number"),
        F.when(seq % 3 == 0, F.col("minor") - 1000).alias("amount_minor"),
        F.when(seq % 5 == 0, F.lit("quarterly")).alias("frequency"),
        F.when(seq % 7 == 0, iso(F.to_date("ts"))).when(seq % 7 == 1, "soon").alias("next_due_date"),
        "ts",
    )


@query
def slot_edits(t: Ledger) -> DataFrame:
    edited = C.edit_slots(t.slots, _slot_edits(t))
    return edited.select(
        "slot_id", *parts("account_number"), *parts("amount_minor"), *parts("next_due_date"), "frequency",
        *recorded("account_number", "amount_minor", "next_due_date"),
    )


@query
def partial_slot_edits(t: Ledger) -> DataFrame:
    seq = F.col("seq")
    forms = t.commands.select(
        "household_id", "kind", "seq",
        F.when(seq % 3 == 0, F.concat(F.lit(" P"), seq.cast("string"))).otherwise(" ").alias("provider"),
        F.when(seq % 4 == 0, F.concat(F.lit("N"), seq.cast("string"))).otherwise("").alias("account_number"),
        F.when(seq % 5 == 0, "£0").when(seq % 5 == 1, F.concat(F.lit("£"), seq.cast("string")))
        .otherwise("?").alias("amount_text"),
        F.lit("weekly").alias("frequency"),
        F.when(seq % 7 == 0, F.to_date("ts")).alias("next_due_date"),
        "ts",
    )
    edited = C.apply_slot_forms(t.slots, forms)
    return edited.select(
        "slot_id", *parts("provider"), *parts("account_number"), *parts("amount_minor"),
        *parts("next_due_date"), "frequency",
        *recorded("provider", "account_number", "amount_minor", "next_due_date"),
    )


@query
def slot_membership(t: Ledger) -> DataFrame:
    """Services added and removed by the commands, kinds cycling through all nine."""
    seq = F.col("seq")
    kinds = coerce.names(S.SERVICE_KINDS)
    changes = t.commands.select(
        "household_id",
        F.element_at(kinds, (seq % 9 + 1).cast("int")).alias("kind"),
        "seq",
        F.when(F.col("action") == "reject", "remove").otherwise("add").alias("action"),
    ).join(t.households.select("household_id"), "household_id", "left_semi")
    return C.change_slots(t.slots, changes).select(
        "slot_id", "household_id", "kind", *parts("provider", "value"),
        F.array_join("lookup_keys", ",").alias("lookup_keys"),
    )


@query
def slot_sync_from_bills(t: Ledger) -> DataFrame:
    """Every third household has recorded its providers and amounts at the start of 1997."""
    at = F.when(F.col("household_id") % 3 == 0, F.lit("1997-01-01").cast("timestamp"))
    slots = t.slots.withColumns({n: F.col(n).withField("recorded_at", at) for n in ("provider", "amount_minor")})
    synced = C.sync_slots(slots, t.bills)
    return synced.select(
        "slot_id", *parts("provider"), *parts("amount_minor"), *parts("next_due_date"), "frequency",
        *recorded("provider", "amount_minor", "next_due_date"),
    )


@query
def bill_commands(t: Ledger) -> DataFrame:
    """Bills inserted, paid, re-priced, noted and deleted by event.

    Inserts come several to an id, and some name a bill there is; some notes are blank.
    """
    seq = F.col("event_id")
    # Ten events meet in three bills, all over the range of bills.
    target = F.concat(F.lit("b-"), F.expr("(event_id - event_id % 10) * 3 div 2 + event_id % 3").cast("string")).alias("bill_id")
    events = t.raw("events")
    minor = F.round(F.col("value") * 100).cast("bigint")
    paid = C.paid_patches(
        events.where((seq % 5 == 0) | ((seq % 5 == 3) & (seq % 2 == 1))).select(target, seq.alias("seq"), (seq % 2 == 0).alias("paid"))
    )
    priced = events.where(seq % 5 == 1).select(
        target, seq.alias("seq"),
        F.when(minor > 0, P.confirmed(minor, "userEntered")).alias("amount_minor"),
        F.when(seq % 3 == 0, P.confirmed(F.to_date("ts"), "userEntered")).alias("due_date"),
        F.when(seq % 15 == 1, "  ").otherwise(F.concat(F.lit(" note "), seq.cast("string"))).alias("notes"),
    )
    inserts = events.where((seq % 5 == 2) | (seq % 5 == 4)).select(
        F.when(seq % 30 == 4, target).otherwise(F.concat(F.lit("n-"), (seq - seq % 10).cast("string"))).alias("bill_id"),
        seq.alias("seq"),
        F.col("user_id").alias("household_id"),
        F.lit("gas").alias("kind"),
        P.missing("string").alias("provider"),
        P.confirmed(minor, "userEntered").alias("amount_minor"),
        P.missing("date").alias("due_date"),
        F.lit("monthly").alias("frequency"),
        F.lit("unknown").alias("payment_status"),
    )
    deletes = events.where((seq % 5 == 3) & (seq % 2 == 0)).select(target)
    changed = C.change_bills(
        t.bills, inserts, paid.unionByName(priced, allowMissingColumns=True), deletes
    )
    return changed.select(
        "bill_id", "household_id", *parts("amount_minor"), *parts("due_date"), "payment_status", "notes"
    )


@query
def reminders_from_bills(t: Ledger) -> DataFrame:
    made = C.reminders_from_bills(t.bills, AS_OF)
    return made.withColumn("due_at", iso("due_at"))


@query
def reminder_commands(t: Ledger) -> DataFrame:
    """Reminders changed, added and removed by event; four events meet in one reminder."""
    seq = F.col("event_id")
    events = t.raw("events")
    target = F.concat(F.lit("r-"), (seq - seq % 4).cast("string")).alias("reminder_id")
    patches = events.where((seq % 4 != 1) & (seq % 40 != 2)).select(
        target,
        seq.alias("seq"),
        F.when(seq % 8 == 0, F.concat(F.lit("T"), seq.cast("string")))
        .when(seq % 4 == 2, F.concat(F.lit("U"), seq.cast("string"))).alias("title"),
        F.when((seq % 12 == 0) | (seq % 4 == 3), F.to_date("ts")).alias("due_at"),
        F.when(seq % 4 == 0, seq % 16 == 0).when(seq % 4 == 3, seq % 3 == 0).alias("is_done"),
    )
    inserts = events.where(seq % 4 == 1).select(
        F.concat(F.lit("new-"), seq.cast("string")).alias("reminder_id"),
        F.col("user_id").alias("household_id"),
        F.lit("custom").alias("kind"),
        F.lit("Added").alias("title"),
        F.to_date("ts").alias("due_at"),
        F.lit(False).alias("is_done"),
    )
    deletes = events.where(seq % 40 == 2).select(target)
    changed = C.change_reminders(t.reminders, inserts, patches, deletes)
    return changed.select("reminder_id", "household_id", "title", iso("due_at").alias("due_at"), "is_done")


@query
def document_commands(t: Ledger) -> DataFrame:
    """Documents from accepted bill texts added, every fourth one deleted, newest first."""
    added = extraction.accept_extracted(_extracted(t), _decisions(t))["documents"].withColumn(
        "document_id", F.concat(F.lit("read-"), F.col("document_id"))
    )
    number = F.substring_index("document_id", "-", -1).cast("bigint")
    deletes = t.documents.where(number % 4 == 0)
    changed = C.change_documents(t.documents, added, deletes)
    listed = relational.list_documents(changed)
    return listed.select(
        "household_id", "document_id", "title", "notes", F.date_format("created_at", "yyyy-MM-dd").alias("created")
    )


def _changed_members(t: Ledger) -> tuple[DataFrame, DataFrame]:
    customer = t.raw("customer")
    key = F.col("c_custkey")
    text = key.cast("string")
    invites = customer.where(key % 4 == 0).select(
        F.concat(F.lit("i-"), text).alias("member_id"), key.alias("household_id"),
        F.concat(F.lit(" "), F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("email"),
        F.lit("viewer").alias("role"), key.alias("seq"),
    )
    roles = customer.where(key % 3 == 0).select(
        F.concat(F.lit("m-"), text, F.lit("-1")).alias("member_id"), F.lit("housemate").alias("role"),
        key.alias("seq"),
    )
    removals = customer.where(key % 5 == 0).select(F.concat(F.lit("m-"), text, F.lit("-0")).alias("member_id"))
    choices = customer.where(key % 8 == 0).select(
        key.alias("household_id"), F.concat(F.lit("i-"), text).alias("member_id"), key.alias("seq")
    )
    return C.change_members(t.households, t.members, invites, roles, removals, choices)


@query
def member_commands(t: Ledger) -> DataFrame:
    _, members = _changed_members(t)
    return members.select("member_id", "household_id", "name", "role", "has_accepted_invite", "pos")


@query
def member_choices(t: Ledger) -> DataFrame:
    households, _ = _changed_members(t)
    return households.select("household_id", "current_member_id")


@query
def property_commands(t: Ledger) -> DataFrame:
    key = F.col("c_custkey")
    moves = t.raw("customer").where(key % 6 == 0).select(
        key.alias("household_id"), key.alias("seq"), F.concat(key.cast("string"), F.lit(" New Road")).alias("line1"),
        F.lit(None).cast("string").alias("line2"), F.lit("York").alias("town"),
        F.lit("YO1 7HH").alias("postcode"), F.lit(None).cast("string").alias("uprn"),
        F.lit("owning").alias("tenure"), F.lit("Manual entry").alias("address_source"),
    )
    tenures = t.raw("customer").where(key % 4 == 0).select(
        key.alias("household_id"), key.alias("seq"), F.lit("other").alias("tenure")
    )
    moved = C.set_tenure(C.replace_properties(t.properties, moves), tenures)
    return moved.select("property_id", "line1", "line2", "town", "postcode", "uprn", "tenure", "is_demo_data")


@query
def onboarding_commands(t: Ledger) -> DataFrame:
    done = t.properties.select("household_id").where(F.col("household_id") % 2 == 0)
    return C.complete_onboarding(t.households, done).select("household_id", "onboarding_complete")


@query
def household_reset(t: Ledger) -> DataFrame:
    """Rows left per table and household once every fifth household is reset."""
    resets = t.households.where(F.col("household_id") % 5 == 0)
    left = C.reset_households(t.tables, resets)
    stacked = None
    for name, table in left.items():
        rows = table.select("household_id", F.lit(name).alias("table_name"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy("household_id", "table_name").agg(F.count("*").alias("row_count"))


# ---- validation --------------------------------------------------------------


@query
def validate_households(t: Ledger) -> DataFrame:
    _, rejected = V.split(t.household_requests, V.household_rules())
    return with_codes(rejected, "household_id")


@query
def validate_bills(t: Ledger) -> DataFrame:
    key = F.substring_index("bill_id", "-", -1).cast("bigint")
    amount = F.col("amount_minor")
    bad = t.bills.withColumns(
        {
            "kind": F.when(key % 13 == 0, "mystery").otherwise(F.col("kind")),
            "amount_minor": F.when(key % 9 == 0, amount.withField("value", -amount["value"])).otherwise(amount),
        }
    )
    _, rejected = V.split(bad, V.bill_rules())
    return with_codes(rejected, "bill_id")


@query
def validate_bill_updates(t: Ledger) -> DataFrame:
    seq = F.col("seq")
    updates = t.commands.select(
        "seq",
        F.when(seq % 3 == 0, "paid").when(seq % 3 == 1, "lost").alias("payment_status"),
        F.when(seq % 4 == 0, P.confirmed(F.col("minor") - 5000, "userEntered"))
        .when(seq % 4 == 1, P.missing("bigint")).alias("amount_minor"),
    )
    return with_codes(V.check(updates, V.bill_update_rules()), "seq")


@query
def validate_slot_updates(t: Ledger) -> DataFrame:
    seq = F.col("seq")
    updates = t.commands.select(
        "seq", "household_id", "kind",
        F.when(seq % 11 == 0, "guess").otherwise(F.col("action")).alias("action"),
        F.when(seq % 4 != 0, F.col("value")).alias("value"),
        F.when(seq % 5 == 0, "12.5").when(seq % 5 == 1, (F.col("minor") - 5000).cast("string")).alias("amount_text"),
    )
    return with_codes(V.check_slot_updates(updates, t.slots), "seq")


@query
def validate_reminders(t: Ledger) -> DataFrame:
    key = F.substring_index("reminder_id", "-", -1).cast("bigint")
    requests = t.reminders.select(
        "reminder_id",
        F.when(key % 5 == 0, " ").when(key % 5 != 1, F.col("title")).alias("title"),
        F.when(key % 7 == 0, "2024-02-30").when(key % 7 == 1, "next week")
        .when(key % 7 != 2, F.concat(iso("due_at"), F.lit("T09:00:00"))).alias("due_text"),
    )
    updated = V.check(requests, V.reminder_update_rules()).withColumnRenamed("codes", "update_codes")
    return V.check(updated, V.reminder_rules()).select("reminder_id", codes(), codes("update_codes"))


@query
def validate_documents(t: Ledger) -> DataFrame:
    number = F.substring_index("document_id", "-", -1).cast("bigint")
    rows = t.documents.withColumn("title", F.when(number % 10 != 9, F.col("title")).otherwise("\t "))
    _, rejected = V.split(rows, V.document_rules())
    return with_codes(rejected, "document_id")


@query
def validate_slots(t: Ledger) -> DataFrame:
    """Field invariants over slots whose provider status was dropped for some."""
    broken = t.slots.withColumn(
        "provider",
        F.when(F.col("household_id") % 3 == 0, F.col("provider").withField("status", F.lit("missing")))
        .otherwise(F.col("provider")),
    )
    _, rejected = V.split(broken, V.field_rules("provider", "amount_minor", "next_due_date"))
    return with_codes(rejected, "slot_id")


@query
def duplicate_slots(t: Ledger) -> DataFrame:
    twice = t.slots.unionByName(t.slots.where(F.col("household_id") % 4 == 0))
    return V.duplicate_slots(twice)


@query
def orphan_rows(t: Ledger) -> DataFrame:
    """Bills whose household does not exist, the households being those with a property."""
    return V.orphans(t.bills.select("bill_id", "household_id"), t.properties).select(
        "bill_id", "household_id"
    )


@query
def command_permissions(t: Ledger) -> DataFrame:
    seq = F.col("seq")
    asked = t.commands.withColumn(
        "action",
        F.when(seq % 6 == 0, "member_role").when(seq % 6 == 1, "set_paid").when(seq % 6 == 2, "add")
        .when(seq % 18 == 3, "borrow").otherwise(F.col("action")),
    ).select("seq", "household_id", "member_id", "action")
    return with_codes(V.check_permissions(asked, t.members), "seq")


@query
def bill_form_checks(t: Ledger) -> DataFrame:
    forms = t.bills.select(
        "bill_id",
        (F.col("household_id") % 2 == 0).alias("date_known"),
        F.col("due_date")["value"].alias("due_date"),
        F.col("amount_minor")["value"].alias("amount_minor"),
    )
    typed = V.check(forms, V.bill_form_rules()).withColumnRenamed("codes", "form_codes")
    return V.check(typed, V.accepted_text_rules()).select("bill_id", codes("form_codes"), codes())


@query
def unknown_enum_warnings(t: Ledger) -> DataFrame:
    key = F.substring_index("bill_id", "-", -1).cast("bigint")
    bad = t.bills.withColumn("frequency", F.when(key % 5 == 0, "yearly").otherwise(F.col("frequency")))
    return with_codes(V.check(bad, V.enum_rules()), "bill_id")


# ---- sources -----------------------------------------------------------------


def _reread(t: Ledger, name: str) -> DataFrame:
    """A table after its way into aggregate documents and back."""
    return documents.READERS[name](documents.parse_documents(documents.household_documents(t.tables)))


@query
def json_bills_roundtrip(t: Ledger) -> DataFrame:
    return _reread(t, "bills").select(
        "bill_id", "household_id", "kind", *parts("provider"), *parts("amount_minor"),
        *parts("due_date"), iso("period_start").alias("period_start"), "frequency", "payment_status",
        "document_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "property_id",
    )


@query
def json_slots_roundtrip(t: Ledger) -> DataFrame:
    return _reread(t, "service_slots").select(
        "slot_id", "household_id", "kind", *parts("provider"), *parts("account_number"),
        *parts("amount_minor"), *parts("next_due_date"), "frequency",
        F.array_join("lookup_keys", ",").alias("lookup_keys"), "property_id",
    )


@query
def json_households_roundtrip(t: Ledger) -> DataFrame:
    lines = documents.household_documents(t.tables)
    parsed = documents.parse_documents(lines)
    homes = documents.read_properties(documents.parse_documents(documents.head_lines(lines))).select(
        "household_id", "line1", "line2", "town", "postcode", "uprn", "tenure", "is_demo_data"
    )
    heads = documents.read_households(parsed).withColumnRenamed("is_demo_data", "document_is_demo_data")
    return heads.join(homes, "household_id", "left")


@query
def json_members_roundtrip(t: Ledger) -> DataFrame:
    return _reread(t, "members").select(
        "member_id", "household_id", "name", "role", "has_accepted_invite", "is_current_user", "pos"
    )


@query
def json_reminders_roundtrip(t: Ledger) -> DataFrame:
    return _reread(t, "reminders").withColumn("due_at", iso("due_at"))


@query
def json_documents_roundtrip(t: Ledger) -> DataFrame:
    return _reread(t, "documents").select(
        "document_id", "household_id", "kind", "title", "provider_name", "content_type", "byte_size", "extracted_text",
        "bill_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "property_id",
    )


def _messy_documents(t: Ledger) -> DataFrame:
    """One small document per event, many of them broken in some way."""
    key = F.col("event_id")
    text = key.cast("string")
    bill = F.concat(
        F.lit('{"id":"x-'), text, F.when(key % 11 == 0, F.lit('","kind":"water')).otherwise(""), F.lit('","kind":"'),
        F.when(key % 3 == 0, "gas").otherwise(F.col("event_type")),
        F.lit('","amountMinor":{"value":'),
        F.when(key % 4 == 0, F.concat(F.lit('"'), text, F.lit('"')))
        .when(key % 4 == 1, F.concat(text, F.lit(".9")))
        .when(key % 4 == 2, F.lit('"lots"')).otherwise(text),
        F.lit(',"source":"'), F.when(key % 5 == 0, "rumour").otherwise("userEntered"),
        F.lit('",'),
        F.when(key % 2 == 0, F.lit('"status":"confirmed"')).otherwise('"needsConfirmation":true'),
        F.lit("},"),
        F.lit('"dueDate":'),
        F.when(key % 6 == 0, F.lit("[]")).otherwise(
            F.concat(F.lit('{"value":"'), iso(F.to_date("ts")), F.lit('T00:00:00.000","status":"confirmed"}'))
        ),
        F.lit(',"frequency":"yearly"}'),
    )
    bills = (
        F.when(key % 7 == 0, F.lit('"not a list"'))
        .when(key % 7 == 1, F.concat(F.lit('["nonsense",'), bill, F.lit(',{"id":""},5]')))
        .otherwise(F.concat(F.lit("["), bill, F.lit("]")))
    )
    whole = F.concat(F.lit('{"version":'), F.when(key % 29 == 0, "2").otherwise("1"), F.lit(',"bills":'), bills, F.lit("}"))
    json = (
        F.when(key % 31 == 0, F.concat(whole, F.lit("}}")))
        .when(key % 37 == 0, F.lit("[1,2]"))
        .otherwise(whole)
    )
    return t.raw("events").select(
        F.when(key % 41 != 0, key).alias("household_id"), json.alias("json")
    )


@query
def json_tolerant_decode(t: Ledger) -> DataFrame:
    bills = documents.read_bills(documents.parse_documents(_messy_documents(t)))
    return bills.select(
        "household_id", "bill_id", "kind", *parts("amount_minor"), *parts("due_date"), "frequency", "payment_status"
    )


@query
def json_quarantine(t: Ledger) -> DataFrame:
    bad = documents.quarantine(documents.parse_documents(_messy_documents(t)))
    return bad.groupBy("reason").agg(F.count("*").alias("document_count"))


@query
def json_unreadable_values(t: Ledger) -> DataFrame:
    return documents.unreadable_values(documents.parse_documents(_messy_documents(t)))


@query
def household_payloads(t: Ledger) -> DataFrame:
    """What the payload lines hold, read back: a row per head and per item."""
    lines = documents.household_payloads(t.tables)
    parsed, known = documents.parse_documents(lines), documents.parse_documents(documents.head_lines(lines))
    homes = documents.read_properties(known).select("household_id", "postcode")
    heads = documents.read_households(known).join(homes, "household_id", "left").select(
        "household_id", F.lit("head").alias("list"), F.col("name").alias("id"), F.col("postcode").alias("kind"),
        *[F.lit(None).cast("string").alias(c) for c in ("value", "status", "label")], F.lit(False).alias("shows_text"),
    )

    def text(path: str) -> Column:
        return coerce.as_string_or_null(coerce.child(F.col("item"), path))

    items = documents.tagged_items(parsed).select(
        "household_id", "list", text("$.id").alias("id"),
        F.coalesce(text("$.kind"), text("$.role")).alias("kind"),
        F.coalesce(text("$.amountMinor.value"), text("$.title"), text("$.name")).alias("value"),
        F.coalesce(text("$.amountMinor.status"), text("$.billId"), text("$.isDone"), text("$.hasAcceptedInvite")).alias("status"),
        F.coalesce(text("$.provider.value"), text("$.providerName"), text("$.dueAt"), text("$.isCurrentUser")).alias("label"),
        coerce.child(F.col("item"), "$.extractedText").isNotNull().alias("shows_text"),
    )
    return heads.unionByName(items)


@query
def payload_pieces(t: Ledger) -> DataFrame:
    """Of each household's payload text: its pieces and commas, and where they stand."""
    pieces = documents.payload_pieces(t.tables)
    starts = F.when(F.startswith("piece", F.lit(",")), 1).otherwise(0)
    return pieces.groupBy("household_id").agg(
        F.count("*").alias("piece_count"),
        F.sum(starts.cast("bigint")).alias("comma_count"),
        F.sum(F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")).alias("frame_count"),
        F.max(F.when(F.col("kind") == 0, F.struct("list", "piece")))["piece"].alias("last_piece"),
        F.countDistinct(F.when(F.col("kind") == 1, F.col("list"))).alias("filled_lists"),
    )


@query
def relational_fields(t: Ledger) -> DataFrame:
    """Bills stored with JSON text fields, decoded."""
    stored = relational.encode_fields(t.bills, "bills")
    back = relational.decode_fields(stored, "bills")
    return back.select("bill_id", *parts("provider"), *parts("amount_minor"), *parts("due_date"))


def _damaged_bills(t: Ledger) -> DataFrame:
    """Stored bills with amounts that are no field, of another type, or badly named, by bill number."""
    number = F.substring("bill_id", 3, 20).cast("bigint") % 16
    stored = relational.encode_fields(t.bills, "bills")
    text = (
        F.when(number == 3, "oops").when(number == 5, "[1]")
        .when(number == 7, '{"value":"12","source":"none","source":"userEntered","status":"confirmed"}')
        .when(number == 9, '{"value":"lots","source":"rumour","status":"sure"}')
        .when(number == 11, '{"value":7,"source":"rumour","status":"confirmed","recordedAt":"yesterday"}')
        .when(number == 13, '{"value":1}}')
    )
    return stored.withColumn("amount_minor", F.coalesce(text, "amount_minor"))


@query
def relational_damaged_fields(t: Ledger) -> DataFrame:
    return relational.decode_fields(_damaged_bills(t), "bills").select("bill_id", *parts("amount_minor"), *parts("due_date"))


@query
def relational_unreadable(t: Ledger) -> DataFrame:
    """What decoding the damaged bills leaves out, and why."""
    return relational.unreadable_fields(_damaged_bills(t), "bills", "bill_id").select("bill_id", "field", codes(), "text")


@query
def document_listing(t: Ledger) -> DataFrame:
    listed = relational.list_documents(t.documents)
    return listed.select(
        "household_id", "document_id", "title",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.lit("extracted_text" in listed.columns).alias("has_text"),
    )


@query
def address_feed(t: Ledger) -> DataFrame:
    """A feed response per customer, with the gaps such responses have."""
    key = F.col("c_custkey")
    text = key.cast("string")
    name = F.col("c_name")
    first = (
        F.when(key % 4 == 0, F.concat(F.lit('{"DPA":{"ADDRESS":" '), name, F.lit(' , Mill Lane","POST_TOWN":" Leeds ","POSTCODE":"LS1 2AB","UPRN":"'), text, F.lit('"}}')))
        .when(key % 4 == 1, F.concat(F.lit('{"DPA":{"BUILDING_NUMBER":"'), text, F.lit('","THOROUGHFARE_NAME":"Mill Lane","UPRN":""}}')))
        .when(key % 4 == 2, F.lit('{"DPA":{}}'))
        .otherwise(F.lit('{"DPA":{"POST_TOWN":"York"}}'))
    )
    responses = t.raw("customer").select(
        "c_custkey",
        F.lit("LS9 9ZZ").alias("postcode"),
        F.concat(F.lit('{"results":['), first, F.lit(',{"LPI":{"UPRN":"1"}}]}')).alias("json"),
    )
    return addresses.parse_feed(responses)


def _damaged_feed(t: Ledger) -> DataFrame:
    """A feed response per customer, some broken as a whole or in single results."""
    key = F.col("c_custkey") % 13
    json = (
        F.when(key == 1, "oops").when(key == 2, "[1]").when(key == 3, '{"results":"none"}').when(key == 4, "{}")
        .when(key == 5, '{"results":[]}')
        .when(key == 6, '{"results":["text",7,{"LPI":{"UPRN":"1"}},{"DPA":[]},{"DPA":{"UPRN":"9","POST_TOWN":"Hull"}}]}')
        .when(key == 7, '{"results":[{"DPA":{"UPRN":"7"}}]}}')
        .otherwise(F.concat(F.lit('{"results":[{"DPA":{"UPRN":"'), F.col("c_custkey").cast("string"), F.lit('"}}]}')))
    )
    return t.raw("customer").select("c_custkey", F.lit("LS9 9ZZ").alias("postcode"), json.alias("json"))


@query
def address_feed_damaged(t: Ledger) -> DataFrame:
    """The addresses that the damaged feed still gives."""
    return addresses.parse_feed(_damaged_feed(t))


@query
def address_feed_quarantine(t: Ledger) -> DataFrame:
    return addresses.feed_quarantine(addresses.read_feed(_damaged_feed(t))).select(
        "c_custkey", F.col("position").cast("bigint").alias("position"), "reason", "json"
    )
