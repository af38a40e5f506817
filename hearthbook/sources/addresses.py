"""Address feed: flatten the responses of an address provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.functions import coerce, scalars as X

# The feed's shape and the placeholder for an unnamed address.
FEED = "struct<results: array<string>>"
RESULT = "struct<DPA: map<string, string>>"
PLACEHOLDER = "Address"


def read_feed(responses: DataFrame, text: str = "json") -> DataFrame:
    """Responses with ``reason`` (null for one that can be read) and ``results``: position, text, block and reason of each.

    Every response is parsed once, and each of its results once more by itself, so that one that can't
    be read takes no other with it. Both ``parse_feed`` and ``feed_quarantine`` read this: write it out
    first to use both.
    """
    response = F.col("_response")
    listed = response["results"]
    opened = responses.withColumn("_response", coerce.whole_object(F.col(text), FEED))
    reason = (
        F.when(response.isNull(), coerce.unreadable_text(F.col(text)))
        .when(listed.isNull() & F.contains(F.col(text), F.lit('"results"')), "results_not_a_list")
        .when(listed.isNull(), "no_results")
    )

    def result(item: Column, position: Column) -> Column:
        parsed = F.get(F.transform(F.array(item), lambda t: F.from_json(t, RESULT)["DPA"]), F.lit(0))
        why = (
            F.when(item.isNull() | ~F.startswith(F.ltrim(item), F.lit("{")), "not_an_object")
            .when(parsed.isNull() | (F.size(parsed) == 0), "no_address")
        )
        return F.struct(position.alias("position"), item.alias("text"), parsed.alias("block"), why.alias("reason"))

    return opened.withColumns({"reason": reason, "results": F.transform(listed, result)}).drop("_response")


def feed_quarantine(feed: DataFrame, text: str = "json") -> DataFrame:
    """What ``read_feed`` could not use: whole responses (no position), and single results with their position.

    Columns: those of the responses, then ``position, reason``, and the text set aside in place of the response.
    """
    others = [c for c in feed.columns if c not in (text, "reason", "results")]
    whole = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.col("reason"), F.col(text).alias(text)))
    single = F.transform(
        F.filter("results", lambda r: r["reason"].isNotNull()),
        lambda r: F.struct(r["position"].alias("position"), r["reason"].alias("reason"), r["text"].alias(text)),
    )
    return feed.select(*others, F.inline(F.when(F.col("reason").isNotNull(), whole).otherwise(single)))


def parse_feed(responses: DataFrame, text: str = "json", postcode: str = "postcode") -> DataFrame:
    """Addresses from response texts; ``postcode`` is the column with the searched one.

    Takes responses or what ``read_feed`` made of them. Results without an address block give no
    address. The first line is the first comma part of the full address, else building and
    street, else a placeholder.
    """
    feed = responses if "results" in responses.columns else read_feed(responses, text)
    others = [name for name in feed.columns if name not in (text, postcode, "reason", "results")]
    blocks = F.transform(F.filter("results", lambda r: r["reason"].isNull()), lambda r: r["block"])
    rows = feed.select(*others, F.col(postcode).alias("_asked"), F.explode(blocks).alias("_block"))

    def given(name: str) -> Column:
        return F.nullif(F.try_element_at("_block", F.lit(name)), F.lit(""))

    first = coerce.non_blank(F.substring_index(given("ADDRESS"), ",", 1))
    building = coerce.non_blank(F.coalesce(given("BUILDING_NAME"), given("BUILDING_NUMBER")))
    composed = F.concat_ws(" ", building, coerce.non_blank(given("THOROUGHFARE_NAME")))
    return rows.select(
        *others,
        F.coalesce(first, F.nullif(composed, F.lit("")), F.lit(PLACEHOLDER)).alias("line1"),
        F.lit(None).cast("string").alias("line2"),
        F.coalesce(coerce.trim(given("POST_TOWN")), F.lit("")).alias("town"),
        coerce.trim(F.coalesce(given("POSTCODE"), F.col("_asked"))).alias("postcode"),
        given("UPRN").alias("uprn"),
    )


def keyed(addresses: DataFrame) -> DataFrame:
    """Addresses with ``postcode_key``, the postcode in its normal form: worked out once, where they come in."""
    return addresses.withColumn("postcode_key", X.normalise_postcode(F.col("postcode")))


def store(addresses: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Write keyed addresses as a table in buckets of ``postcode_key``, sorted within.

    Searches join it where it lies: only the requests are shuffled, to its buckets.
    """
    writer = keyed(addresses).write.bucketBy(buckets, "postcode_key").sortBy("postcode_key").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
