"""Reference dimensions: regional providers, look-up pages, default keys.

The built-in rows are samples for tests and demonstrations. Real deployments pass
their own tables of the same shape, from Parquet or CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --------------------------------------------------------------------------
# Sample providers by postcode area, look-up pages, default keys.
# --------------------------------------------------------------------------
SAMPLE_WATER = {
    "BS": "Wessex Water (sample)",
    "CF": "Dŵr Cymru Welsh Water (sample)",
    "LS": "Yorkshire Water (sample)",
    "M": "United Utilities (sample)",
    "SW": "Thames Water (sample)",
}
SAMPLE_COUNCIL = {
    "BS": "Bristol City Council (sample)",
    "CF": "Cardiff Council (sample)",
    "LS": "Leeds City Council (sample)",
    "M": "Manchester City Council (sample)",
    "SW": "London Borough of Wandsworth (sample)",
}
LOOKUP_LINKS = {
    "electricity_supplier": (
        "Find your electricity supplier",
        "Energy Networks Association",
        "https://www.energynetworks.org/operating-the-networks/whos-my-network-operator",
    ),
    "gas_supplier": (
        "Find your gas supplier",
        "Gas supplier database",
        "https://www.gassupplierdatabase.co.uk/",
    ),
    "water_provider": (
        "Find your water and sewerage company",
        "Water UK",
        "https://www.water.org.uk/customers/find-your-supplier/",
    ),
    "council_tax": (
        "Check your council tax band",
        "GOV.UK",
        "https://www.gov.uk/council-tax-bands",
    ),
    "find_council": (
        "Find your local council",
        "GOV.UK",
        "https://www.gov.uk/find-local-council",
    ),
    "tv_licence": ("TV Licence", "TV Licensing", "https://www.tvlicensing.co.uk/"),
    "meter_points": (
        "Understanding MPAN and MPRN",
        "Ofgem",
        "https://www.ofgem.gov.uk/information-consumers/energy-advice-households/"
        "how-read-your-gas-and-electricity-meter",
    ),
}
DEFAULT_LOOKUP_KEYS = {
    "electricity": ("electricity_supplier",),
    "gas": ("gas_supplier",),
    "water": ("water_provider",),
    "wastewater": ("water_provider",),
    "councilTax": ("council_tax", "find_council"),
    "tvLicence": ("tv_licence",),
}
# What a suggestion of each regional kind is worth, and the pages that can settle it.
REGIONAL_KINDS = {
    "water": ("areaCertain", ("water_provider",)),
    "wastewater": ("areaOnly", ("water_provider",)),
    "councilTax": ("areaCertain", ("council_tax", "find_council")),
}


def _rows(spark: SparkSession, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> DataFrame:
    """A small table from literals, whose size the optimizer can see."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def provider_table(spark: SparkSession, providers: dict[str, str]) -> DataFrame:
    return _rows(spark, ("prefix", "provider"), list(providers.items()))


def area_providers(water: DataFrame, wastewater: DataFrame, council: DataFrame) -> DataFrame:
    """One table of regional providers from the three ``prefix, provider`` tables.

    Wastewater has its own table, although its rows may equal those of water.
    """
    tables = {"water": water, "wastewater": wastewater, "councilTax": council}
    combined = None
    for kind, table in tables.items():
        confidence, keys = REGIONAL_KINDS[kind]
        part = table.select(
            "prefix",
            F.lit(kind).alias("kind"),
            "provider",
            F.lit(confidence).alias("confidence"),
            F.array(*map(F.lit, keys)).alias("lookup_keys"),
        )
        combined = part if combined is None else combined.unionByName(part)
    return combined


def sample_area_providers(spark: SparkSession) -> DataFrame:
    water = provider_table(spark, SAMPLE_WATER)
    return area_providers(water, water, provider_table(spark, SAMPLE_COUNCIL))


def lookup_links(spark: SparkSession) -> DataFrame:
    rows = [(key, *values) for key, values in LOOKUP_LINKS.items()]
    return _rows(spark, ("key", "title", "operator", "url"), rows)


def default_lookup_keys(kind: Column) -> Column:
    """The pages a new service of this kind points to."""
    chain = F
    for name, keys in DEFAULT_LOOKUP_KEYS.items():
        chain = chain.when(kind == name, F.array(*map(F.lit, keys)))
    return chain.otherwise(F.array().cast("array<string>"))
