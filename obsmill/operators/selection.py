"""Choosing observations: selections, option lists, literal search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.functions.text import any_column_contains
from obsmill.schema import (
    AGGREGATE_CPC_MARK,
    ANNUAL,
    AREA_HARVESTED,
    CPC_COLUMN,
    CROP_ELEMENTS,
    M49_COLUMN,
    MONTHS_COLUMN,
)

# Beyond this many literals a semi-join plans and runs better than a long IN.
MAX_IN_LITERALS = 1000


@dataclass(frozen=True)
class Selection:
    """What to keep.  None sets no constraint; an empty list keeps nothing."""

    areas: Sequence[str] | None = None
    items: Sequence[str] | None = None
    elements: Sequence[str] | None = None
    years: tuple[int, int] | None = None


def _among(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    if values is None:
        return df
    values = list(dict.fromkeys(values))
    if len(values) <= MAX_IN_LITERALS:
        return df.where(F.col(column).isin(values))
    kind = df.schema[column].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind}")
    return df.join(wanted, column, "left_semi")


def apply_selection(df: DataFrame, selection: Selection) -> DataFrame:
    for column, values in (
        ("Area", selection.areas),
        ("Item", selection.items),
        ("Element", selection.elements),
    ):
        df = _among(df, column, values)
    if selection.years is not None:
        df = df.where(F.col("Year").between(*selection.years))
    return df


def annual_only(df: DataFrame) -> DataFrame:
    """Yearly prices only; months, indices and other periods never mix with them."""
    return df.where(F.col(MONTHS_COLUMN) == ANNUAL)


def select_observations(df: DataFrame, domain: str, selection: Selection) -> DataFrame:
    """One domain under a selection, all columns; PP keeps annual prices only."""
    if "Domain" in df.columns:
        df = df.where(F.col("Domain") == domain)
    if domain == "PP":
        df = annual_only(df)
    return apply_selection(df, selection)


def canonical_order() -> list[Column]:
    """The order of published tables; sort by it when presenting, not before."""
    return [F.col(c).asc_nulls_last() for c in ("Area", "Item", "Element", "Year")]


def is_primary() -> Column:
    """A harvested area of a single crop; a missing item or crop code does not count."""
    return F.coalesce(
        (F.col("Element") == AREA_HARVESTED)
        & ~F.contains(F.col(CPC_COLUMN), F.lit(AGGREGATE_CPC_MARK))
        & F.col("Item").isNotNull(),
        F.lit(False),
    )


def primary_items(crops: DataFrame) -> DataFrame:
    """Items with a harvested area that are single crops, not groups of crops."""
    return crops.where(is_primary()).select("Item").distinct()


def area_table(crops: DataFrame) -> DataFrame:
    return crops.select("Area", M49_COLUMN).distinct()


def availability(crops: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Years on record per (Area, Item) of the given or else the primary items.

    Years are made distinct before they are gathered, so an array never holds
    more entries than there are years.
    """
    items = primary_items(crops) if items is None else items
    years = (
        crops.where(F.col("Element").isin(*CROP_ELEMENTS))
        .groupBy("Area", "Item", "Year")
        .agg(F.bool_or(F.col("Element") == AREA_HARVESTED).alias("harvested"))
    )
    index = years.groupBy("Area", "Item").agg(
        F.sort_array(F.collect_list("Year")).alias("Years"),
        F.bool_or("harvested").alias("harvested"),
    )
    return index.join(items, "Item", "left_semi").select(
        "Area", "Item", "Years", "harvested"
    )


def available_items(index: DataFrame, areas: Sequence[str] | None = None) -> DataFrame:
    """Crops with a harvested-area record in any of the areas (from the index)."""
    return _among(index.where("harvested"), "Area", areas).select("Item").distinct()


def items_with_rows(df: DataFrame) -> DataFrame:
    """Items offered for a domain that has no harvested areas: those with any row."""
    return df.where(F.col("Item").isNotNull()).select("Item").distinct()


def available_years(
    index: DataFrame, areas: Sequence[str] | None = None, items: Sequence[str] | None = None
) -> DataFrame:
    chosen = _among(_among(index, "Area", areas), "Item", items)
    return chosen.select(F.explode("Years").alias("Year")).distinct()


def years_on_record(df: DataFrame, selection: Selection) -> DataFrame:
    """The same from the facts, when elements matter or there is no index."""
    return (
        apply_selection(df, selection).where(F.col("Year").isNotNull()).select("Year").distinct()
    )


def dimensions(df: DataFrame, by: Sequence[str] = (), first: str = "Year", last: str = "Year") -> DataFrame:
    """Members of each dimension and the range of years, one row per member.

    `first` and `last` hold the range of a row's years, where it stands for several.

    The dimension "all" has the overall range, its member is null.  Long form
    on purpose: one scan, no member list is gathered into one cell.
    """
    by = list(by)

    def member(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("dimension"), value.cast("string").alias("member"))

    kinds = [member(kind, F.col(kind.capitalize())) for kind in ("area", "item", "element")]

    members = (
        df.withColumn(
            "_m",
            F.explode(F.array(member("all", F.lit(None)), *kinds)),
        )
        .where(F.col("_m.member").isNotNull() | (F.col("_m.dimension") == "all"))
        .groupBy(*by, "_m")
        .agg(F.min(first).alias("min_year"), F.max(last).alias("max_year"))
    )
    return members.select(*by, "_m.dimension", "_m.member", "min_year", "max_year")


def default_period(df: DataFrame, by: Sequence[str] = (), first_year: int = 2000) -> DataFrame:
    """First offered year from `first_year` on (else the first one) to the last."""
    year = F.col("Year")
    return df.groupBy(*by).agg(
        F.coalesce(F.min(F.when(year >= first_year, year)), F.min(year)).alias("from_year"),
        F.max(year).alias("to_year"),
    )


def default_item(items: DataFrame, preferred: str, by: Sequence[str] = ()) -> DataFrame:
    """The preferred item where it is offered, else the first one in order."""
    item = F.col("Item")
    return items.groupBy(*by).agg(
        F.coalesce(F.max(F.when(item == preferred, item)), F.min(item)).alias("Item")
    )


def literal_search(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column holds the text; no pattern syntax, case ignored."""
    return df.where(any_column_contains(df, text)) if text else df
