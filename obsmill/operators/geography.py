"""Geography by exact area code, never by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmill.functions.values import m49_number
from obsmill.schema import M49_COLUMN, UNCLASSIFIED

GEOGRAPHY_COLUMNS = ("ISO3", "Continent", "Region", "M49")


def geography_lookup(source: DataFrame, continents: dict[str, str] | None = None) -> DataFrame:
    """One row per numeric code from a country list.

    The UN code counts, the ISO numeric code fills in where there is none.  Of
    several rows with one code the one with the lowest ISO3 stays.
    """
    continent = F.col("continent")
    for name, label in (continents or {}).items():
        continent = F.when(F.col("continent") == name, F.lit(label)).otherwise(continent)
    rows = source.select(
        F.coalesce("UNcode", "ISOnumeric").cast("int").alias("M49"),
        "ISO3",
        continent.alias("Continent"),
        F.col("UNregion").alias("Region"),
    ).where(F.col("M49").isNotNull())
    first = F.min(
        F.struct(F.col("ISO3").isNull().alias("no_iso3"), "ISO3", "Continent", "Region")
    )
    return (
        rows.groupBy("M49")
        .agg(first.alias("_f"))
        .select("M49", "_f.ISO3", "_f.Continent", "_f.Region")
    )


def _one_per_code(lookup: DataFrame) -> DataFrame:
    """Refuses a lookup in which a code comes twice: a join would double observations."""
    twice = F.raise_error(F.concat(F.lit("the geography has more than one row for code "), F.col("M49").cast("string")))
    rows = F.when(F.count("*") == 1, F.first(F.struct("ISO3", "Continent", "Region"))).otherwise(twice)
    known = lookup.where(F.col("M49").isNotNull())
    return known.groupBy("M49").agg(rows.alias("_g")).select("M49", "_g.ISO3", "_g.Continent", "_g.Region")


def enrich_geography(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """ISO3, continent and region by code; rows without a match stay, unclassified."""
    df = df.drop(*GEOGRAPHY_COLUMNS)
    if M49_COLUMN not in df.columns:
        return df.withColumns(
            {
                "ISO3": F.lit(None).cast("string"),
                "Continent": F.lit(UNCLASSIFIED),
                "Region": F.lit(UNCLASSIFIED),
            }
        )
    coded = df.withColumn("M49", m49_number(F.col(M49_COLUMN)))
    return coded.join(_one_per_code(lookup), "M49", "left").withColumns(
        {
            "Continent": F.coalesce("Continent", F.lit(UNCLASSIFIED)),
            "Region": F.coalesce("Region", F.lit(UNCLASSIFIED)),
        }
    )


def country_areas(enriched: DataFrame) -> DataFrame:
    """Areas with an ISO3 code, one row each; groups of countries have none.

    An area under two codes keeps the lowest one.
    """
    lowest = F.min(F.struct("M49", "ISO3", "Continent", "Region"))
    return (
        enriched.where(F.col("ISO3").isNotNull())
        .groupBy("Area")
        .agg(lowest.alias("_g"))
        .select("Area", "_g.M49", "_g.ISO3", "_g.Continent", "_g.Region")
    )


def scope_areas(
    countries: DataFrame,
    continent: str | None = None,
    region: str | None = None,
    areas: Sequence[str] | None = None,
) -> DataFrame:
    """Countries in scope: continent, then region, then a list; nothing chosen is all."""
    if continent is not None:
        countries = countries.where(F.col("Continent") == continent)
    if region is not None:
        countries = countries.where(F.col("Region") == region)
    if areas:
        countries = countries.where(F.col("Area").isin(list(areas)))
    return countries


def in_scope(df: DataFrame, scope: DataFrame) -> DataFrame:
    return df.join(scope.select("Area"), "Area", "left_semi")
