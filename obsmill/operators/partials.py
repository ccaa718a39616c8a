"""Mergeable states of crop figures per area, item and year.

A state holds what any grouping of its keys needs: exact sums as the parts that
add up without loss, numbers of rows, and the paired yield and harvested area.
Key figures, rankings and yields follow from states as they do from the
observations, without reading these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.functions.values import CELL
from obsmill.operators.measures import observed, paired, single, yields_of
from obsmill.schema import AREA_HARVESTED, CROP_UNITS, KEYS, PRODUCTION, YIELD

SUMS = {PRODUCTION: "production", AREA_HARVESTED: "area"}


def _parts(element: str, name: str) -> list[Column]:
    """The parts of an exact sum in the reporting unit, and how many rows it has, with or without a value."""
    value = F.when(observed(element), F.col("Value"))
    cell = value.try_cast(CELL)
    rest = value - F.coalesce(cell.cast("double"), F.lit(0.0))
    return [
        F.sum(cell).cast("decimal(38,12)").alias(f"{name}_cell"),
        F.sum(rest).alias(f"{name}_rest"),
        F.count(F.when(observed(element), 1)).alias(f"{name}_rows"),
    ]


def crop_states(crops: DataFrame) -> DataFrame:
    """One state for each area, item and year of the three elements; null keys are keys like others."""
    return paired(crops, *[part for element, name in SUMS.items() for part in _parts(element, name)])


def price_states(prices: DataFrame) -> DataFrame:
    """How many prices an area, item and year has, and the highest of them; takes annual prices."""
    return prices.groupBy(*KEYS).agg(F.count("Value").alias("n_prices"), F.max("Value").alias("price"))


def _sum_of(name: str) -> Column:
    return F.coalesce(F.col(f"{name}_cell").cast("double"), F.lit(0.0)) + F.col(f"{name}_rest")


def cells(states: DataFrame) -> DataFrame:
    """The same rows as `measures.key_cells` gives for the observations."""
    return states.select(
        *KEYS,
        single("yield_kg_ha", "n_yield"),
        single("harvested_ha", "n_area"),
        _sum_of("production").alias("production_t"),
        _sum_of("area").alias("area_ha"),
    )


def merged(states: DataFrame, element: str, groups: Sequence[str]) -> DataFrame:
    """An element by groups of the keys, in its reporting unit: `measures.aggregate` of the observations in that unit."""
    if element == YIELD:
        return yields_of(cells(states), groups)
    name = SUMS[element]
    rows = states.where(F.col(f"{name}_rows") > 0).groupBy(*groups)
    sums = rows.agg(F.sum(f"{name}_cell").alias(f"{name}_cell"), F.sum(f"{name}_rest").alias(f"{name}_rest"))
    return sums.select(*groups, F.lit(CROP_UNITS[element]).alias("Unit"), _sum_of(name).alias("Value"))


def prices_of(states: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The price where exactly one row has a value, otherwise null."""
    return states.groupBy(*groups).agg(F.when(F.sum("n_prices") == 1, F.max("price")).alias("price"))
