"""Provider discovery from postcodes, and the merge in which the resident wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook import schema as S
from hearthbook.functions import coerce, fields as P, scalars as X

# An address cannot tell who supplies energy; these rows say so.
UNKNOWN_KINDS = {"electricity": "electricity_supplier", "gas": "gas_supplier"}

_SUGGESTION = (
    "array<struct<kind:string,provider:string,confidence:string,lookup_keys:array<string>>>"
)


def by_area(area_providers: DataFrame) -> DataFrame:
    """``prefix, kind, provider_count, provider, confidence, lookup_keys``: what is known of each area and kind.

    With several providers in an area none of them is certain: provider is null and confidence is
    ``unknown``; the pages that can settle it stay. Repeated rows of one provider count once.
    """
    many = F.min("provider") != F.max("provider")
    entry = F.min_by(F.struct("provider", "confidence", "lookup_keys"), "provider")
    found = area_providers.where(F.col("kind").isin(*S.SERVICE_KINDS) & F.col("provider").isNotNull()).groupBy("prefix", "kind").agg(
        F.countDistinct("provider").alias("provider_count"), F.coalesce(many, F.lit(False)).alias("_many"), entry.alias("_entry")
    )
    return found.select(
        "prefix", "kind", "provider_count",
        F.when(~F.col("_many"), F.col("_entry.provider")).alias("provider"),
        F.when(F.col("_many"), "unknown").otherwise(F.col("_entry.confidence")).alias("confidence"),
        F.col("_entry.lookup_keys").alias("lookup_keys"),
    )


def ambiguous_areas(area_providers: DataFrame) -> DataFrame:
    """``prefix, kind, provider_count, provider``: each provider of the areas that have several for a kind."""
    several = by_area(area_providers).where("provider_count > 1").select("prefix", "kind", "provider_count")
    return area_providers.select("prefix", "kind", "provider").distinct().join(several, ["prefix", "kind"]).select(
        "prefix", "kind", "provider_count", "provider"
    )


def discover(properties: DataFrame, area_providers: DataFrame, at: Column | None = None) -> DataFrame:
    """Suggestions per household: regional providers, plus unknown energy rows.

    ``area_providers`` has ``prefix, kind, provider, confidence, lookup_keys`` (see
    ``sources.dimensions.area_providers``). It is folded to one row per area, so
    properties are read once and joined once; a kind with several providers in an area is suggested
    as unknown (``by_area``). ``at`` is when suggestions are made: what they are recorded with.
    The join carries no hint: Spark broadcasts the areas while they are below its size threshold and
    shuffles beyond it.
    """
    known = (
        by_area(area_providers)
        .groupBy("prefix")
        .agg(F.collect_list(F.struct("kind", "provider", "confidence", "lookup_keys")).alias("found"))
    )
    unknown = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(None).cast("string").alias("provider"),
                F.lit("unknown").alias("confidence"),
                F.array(F.lit(key)).alias("lookup_keys"),
            )
            for kind, key in UNKNOWN_KINDS.items()
        ]
    ).cast(_SUGGESTION)
    nothing = F.array().cast(_SUGGESTION)
    placed = properties.select(S.KEY, X.area_prefix(F.col("postcode")).alias("prefix"))
    found = placed.join(known, "prefix", "left").select(
        S.KEY,
        F.explode(F.concat(F.coalesce(F.col("found").cast(_SUGGESTION), nothing), unknown)).alias("s"),
    )
    return found.select(
        S.KEY,
        F.col("s.kind").alias("kind"),
        P.suggested(F.col("s.provider"), "postcodeLookup", F.col("s.confidence"), at).alias("provider"),
        F.col("s.confidence").alias("confidence"),
        F.col("s.lookup_keys").alias("lookup_keys"),
    )


def apply_suggestions(slots: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Slots with suggestions merged in, and an ``applied`` flag.

    A provider that is confirmed, or that came from the resident, is never
    touched, and a missing suggestion never replaces anything. ``suggestions``
    holds at most one row per household and kind, as ``discover`` returns it.
    """
    offered = suggestions.select(
        S.KEY,
        "kind",
        F.col("provider").alias("offer"),
        F.col("lookup_keys").alias("offer_keys"),
    ).where(F.col("offer")["value"].isNotNull())
    joined = slots.join(offered, [S.KEY, "kind"], "left")
    own = P.is_confirmed(F.col("provider")) | P.is_human_confirmed(F.col("provider"))
    applied = F.col("offer").isNotNull() & ~own
    keys = F.coalesce(F.col("lookup_keys"), F.array().cast("array<string>"))
    merged = {
        "provider": F.when(applied, F.col("offer")).otherwise(F.col("provider")),
        "lookup_keys": F.when(
            applied, F.array_union(keys, F.coalesce("offer_keys", F.array().cast("array<string>")))
        ).otherwise(F.col("lookup_keys")),
    }
    kept = [merged[name].alias(name) if name in merged else F.col(name) for name in slots.columns]
    return joined.select(*kept, applied.alias("applied"))


def applied_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy(S.KEY).agg(F.count_if("applied").alias("applied_count"))


def missing_kinds(households: DataFrame, slots: DataFrame) -> DataFrame:
    """Service kinds a household does not have yet.

    The set of kinds per household holds at most the nine known names, so it is
    small however many rows a household has.
    """
    stacked = households.select(S.KEY, F.lit(1).alias("known")).unionByName(
        slots.where(F.col("kind").isin(*S.SERVICE_KINDS)).select(S.KEY, "kind"),
        allowMissingColumns=True,
    )
    held = stacked.groupBy(S.KEY).agg(
        F.max("known").alias("known"), F.collect_set("kind").alias("kinds")
    )
    every = coerce.names(S.SERVICE_KINDS)
    return held.where("known = 1").select(
        S.KEY, F.explode(F.array_except(every, "kinds")).alias("kind")
    )


def kinds_still_needed(slots: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Kinds in the household for which discovery named no provider."""
    found = suggestions.where(P.has_value(F.col("provider"))).select(S.KEY, "kind")
    return slots.select(S.KEY, "kind").join(found, [S.KEY, "kind"], "left_anti")


def without_property(households: DataFrame, properties: DataFrame) -> DataFrame:
    """Households that cannot be discovered for, because they have no property."""
    return households.select(S.KEY).join(properties.select(S.KEY), S.KEY, "left_anti")
