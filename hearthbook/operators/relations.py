"""Look-ups between tables: addresses, links, documents, members."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, scalars as X


def search_addresses(requests: DataFrame, addresses: DataFrame) -> DataFrame:
    """Addresses at each requested postcode. ``requests`` has ``request_id, postcode``.

    Stored addresses with a ``postcode_key`` are joined by that column as it is (``sources.addresses.store``);
    others are normalised on the way.
    """
    wanted = _valid_requests(requests)
    return wanted.join(_by_postcode(addresses), "postcode")


def unmatched_requests(requests: DataFrame, addresses: DataFrame) -> DataFrame:
    """Requests no address answers: well-formed but unknown, or not a postcode."""
    well_formed = X.looks_like_postcode(X.normalise_postcode(F.col("postcode")))
    unknown = _valid_requests(requests).join(
        _by_postcode(addresses).select("postcode"), "postcode", "left_anti"
    )
    malformed = requests.where(~F.coalesce(well_formed, F.lit(False)))
    return unknown.select("request_id", F.lit("no_address").alias("reason")).unionByName(
        malformed.select("request_id", F.lit("not_a_postcode").alias("reason"))
    )


def _valid_requests(requests: DataFrame) -> DataFrame:
    tidy = requests.select("request_id", X.normalise_postcode(F.col("postcode")).alias("postcode"))
    return tidy.where(X.looks_like_postcode(F.col("postcode")))


def _by_postcode(addresses: DataFrame) -> DataFrame:
    if "postcode_key" in addresses.columns:
        return addresses.drop("postcode").withColumnRenamed("postcode_key", "postcode")
    return addresses.withColumn("postcode", X.normalise_postcode(F.col("postcode")))


def addresses_by_uprn(requests: DataFrame, addresses: DataFrame) -> DataFrame:
    """The address behind each property reference; unknown references drop out."""
    return requests.select("request_id", "uprn").join(addresses, "uprn")


def slot_links(slots: DataFrame, links: DataFrame) -> DataFrame:
    """Official look-up pages of a service, in the order of its keys."""
    keyed = slots.select("slot_id", S.KEY, F.posexplode("lookup_keys").alias("pos", "key"))
    return keyed.join(links, "key").orderBy(S.KEY, "slot_id", "pos")


def service_for_bill(bills: DataFrame, slots: DataFrame) -> DataFrame:
    """Each bill with the slot of its kind, if the household has one.

    Slots grow with the households, so they are merged and not broadcast, whatever Spark takes their size for.
    """
    first = slots.groupBy(S.KEY, "kind").agg(F.min("slot_id").alias("slot_id"))
    return bills.select("bill_id", S.KEY, "kind").join(first.hint("merge"), [S.KEY, "kind"], "left")


def bill_documents(bills: DataFrame, documents: DataFrame) -> DataFrame:
    """Bills with the document they were read from (null where there is none).

    Most bills have no document. Those stay out of the join, where they would all
    meet in the partition of the null key.
    """
    titles = documents.select("document_id", "title", "provider_name")
    bills = bills.select("document_id", "bill_id", S.KEY)
    linked = bills.where(F.col("document_id").isNotNull()).join(titles, "document_id", "left")
    return linked.unionByName(bills.where(F.col("document_id").isNull()), allowMissingColumns=True)


def broken_links(bills: DataFrame, documents: DataFrame) -> DataFrame:
    """Links that lead nowhere, from either side."""
    to_document = (
        bills.where(F.col("document_id").isNotNull())
        .select("bill_id", "document_id")
        .join(documents.select("document_id"), "document_id", "left_anti")
        .select(F.col("bill_id").alias("from_id"), F.col("document_id").alias("to_id"),
                F.lit("bill_to_document").alias("link"))
    )
    to_bill = (
        documents.where(F.col("bill_id").isNotNull())
        .select("document_id", "bill_id")
        .join(bills.select("bill_id"), "bill_id", "left_anti")
        .select(F.col("document_id").alias("from_id"), F.col("bill_id").alias("to_id"),
                F.lit("document_to_bill").alias("link"))
    )
    return to_document.unionByName(to_bill)


def current_members(households: DataFrame, members: DataFrame) -> DataFrame:
    """The acting member per household and their role.

    The member with the household's current id, else the first member, else none
    with the role owner. Members are matched on household and member id together
    and then reduced with ``min_by``, so no task sees a whole large household.
    """
    current = households.select(
        S.KEY, F.col("current_member_id").alias("member_id"), F.lit(0).alias("chosen")
    )
    candidates = members.select(S.KEY, "member_id", "role", "pos").join(
        current, [S.KEY, "member_id"], "left"
    )
    pick = F.struct(F.coalesce("chosen", F.lit(1)), "pos", "member_id")
    best = candidates.groupBy(S.KEY).agg(
        F.min_by(F.struct("member_id", "role"), pick).alias("member")
    )
    return households.select(S.KEY).join(best, S.KEY, "left").select(
        S.KEY,
        F.col("member.member_id").alias("member_id"),
        F.coalesce("member.role", F.lit("owner")).alias("role"),
    )


def role_permissions(roles: DataFrame) -> DataFrame:
    role = F.col("role")
    return roles.select(
        "*",
        X.can_edit_bills(role).alias("can_edit_bills"),
        X.can_manage_household(role).alias("can_manage_household"),
        X.can_see_amounts(role).alias("can_see_amounts"),
    )


def masked_bills(bills: DataFrame, current: DataFrame) -> DataFrame:
    """Bill amounts as the household's acting member may see them."""
    roles = current.select(S.KEY, "role")
    joined = bills.select("bill_id", S.KEY, "amount_minor").join(roles, S.KEY, "left")
    role = F.coalesce("role", F.lit("owner"))
    return joined.select(
        "bill_id",
        S.KEY,
        role.alias("role"),
        X.masked_money(F.col("amount_minor")["value"], role).alias("amount_text"),
    )


def requested_services(requests: DataFrame) -> DataFrame:
    """Distinct requested service kinds in first-mention order, with unknown ones flagged."""
    distinct = F.array_distinct(F.coalesce("services", F.array().cast("array<string>")))
    known = coerce.names(S.SERVICE_KINDS)
    return requests.select(
        S.KEY,
        F.array_except(distinct, known).alias("unknown"),
        F.posexplode(distinct).alias("pos", "kind"),
    )
