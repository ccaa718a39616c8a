"""Unit-safe sums, area-weighted yields and coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.functions.values import exact_sum, yield_unit, yield_value
from obsmill.schema import AREA_HARVESTED, CROP_ELEMENTS, CROP_UNITS, KEYS, PRODUCTION, YIELD


def normalize_yields(df: DataFrame) -> DataFrame:
    """Yields of a known unit in kg/ha; every other row unchanged."""
    return df.withColumns({"Value": yield_value(), "Unit": yield_unit()})


def total(df: DataFrame, element: str, year: int, unit: str) -> DataFrame:
    """One row: the sum of the values present, null when there is none."""
    return df.where(
        (F.col("Element") == element) & (F.col("Year") == year) & (F.col("Unit") == unit)
    ).agg(exact_sum(F.col("Value")).alias("Value"))


def sum_by(df: DataFrame, element: str, groups: Sequence[str]) -> DataFrame:
    """Sums per group and unit; units never mix and null keys form groups."""
    return (
        df.where(F.col("Element") == element)
        .groupBy(*groups, "Unit")
        .agg(exact_sum(F.col("Value")).alias("Value"))
    )


def observed(element: str) -> Column:
    """The element in its reporting unit, once yields are normalised."""
    return (F.col("Element") == element) & (F.col("Unit") == CROP_UNITS[element])


def paired(df: DataFrame, *more: Column) -> DataFrame:
    """Per key the yield, the harvested area and how many there are of each, and more aggregates of normalised rows."""
    rows = normalize_yields(df.where(F.col("Element").isin(*CROP_ELEMENTS)))
    harvest, yielded = observed(AREA_HARVESTED), observed(YIELD)
    return rows.groupBy(*KEYS).agg(
        F.max(F.when(yielded, F.col("Value"))).alias("yield_kg_ha"),
        F.max(F.when(harvest, F.col("Value"))).alias("harvested_ha"),
        F.count(F.when(yielded, 1)).alias("n_yield"),
        F.count(F.when(harvest, 1)).alias("n_area"),
        *more,
    )


def single(value: str, n: str) -> Column:
    """A value of which a key may have one only."""
    error = F.raise_error(F.lit(f"more than one {value} for one Area, Item and Year"))
    return F.when(F.col(n) > 1, error.cast("double")).otherwise(F.col(value)).alias(value)


def key_cells(df: DataFrame) -> DataFrame:
    """Per key the yield and the harvested area, as in `paired_yield_area`, and the sums in reporting units."""

    def summed(element: str) -> Column:
        return exact_sum(F.when(observed(element), F.col("Value")))

    sums = (summed(PRODUCTION).alias("production_t"), summed(AREA_HARVESTED).alias("area_ha"))
    return paired(df, *sums).select(
        *KEYS, single("yield_kg_ha", "n_yield"), single("harvested_ha", "n_area"), "production_t", "area_ha"
    )


def duplicate_observations(df: DataFrame) -> DataFrame:
    """Keys with more than one yield or harvested area after unit normalisation."""
    return paired(df).where((F.col("n_yield") > 1) | (F.col("n_area") > 1)).select(
        *KEYS, "n_yield", "n_area"
    )


def paired_yield_area(df: DataFrame) -> DataFrame:
    """Yield and harvested area side by side for every key of the three elements.

    One aggregation instead of two joins, so null keys pair up and a hot key
    collapses before the shuffle.  A key with two yields or areas is an error.
    """
    return paired(df).select(*KEYS, single("yield_kg_ha", "n_yield"), single("harvested_ha", "n_area"))


def yield_coverage(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """How many keys of a group have a yield, an area, a positive area."""
    return _yield_sums(df, groups).select(*groups, "n_rows", "n_yield", "n_area", "n_positive_area")


def _yield_sums(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return _sums_of_pairs(paired_yield_area(df), groups)


def _sums_of_pairs(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    unknown = [g for g in groups if g not in KEYS]
    if unknown:
        raise ValueError(f"yields can be grouped by {KEYS}, not by {unknown}")
    y, a = F.col("yield_kg_ha"), F.col("harvested_ha")
    return pairs.groupBy(*groups).agg(
        F.count("*").alias("n_rows"),
        F.count(y).alias("n_yield"),
        F.count(a).alias("n_area"),
        F.count(F.when(a > 0, 1)).alias("n_positive_area"),
        F.max(y).alias("only_yield"),
        exact_sum(y * a).alias("weighted"),
        exact_sum(a).alias("harvested"),
    )


def yield_of(part: Callable[[str], Column]) -> Column:
    """The yield of a group from its counts and sums, by the rule of `weighted_yield`."""
    complete = (part("n_yield") == part("n_rows")) & (part("n_positive_area") == part("n_rows"))
    weighted = F.when(complete, part("weighted") / part("harvested"))
    return F.when(part("n_rows") == 1, part("only_yield")).otherwise(weighted)


def weighted_yield(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Yield of a group, weighted by harvested area.

    A group of one key keeps its published yield.  A larger group has a yield
    only when every key has a yield and a positive area; partial coverage
    gives null, and nothing is rebuilt from production.
    """
    return yields_of(paired_yield_area(df), groups)


def yields_of(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The same from yields and harvested areas side by side."""
    return _sums_of_pairs(pairs, groups).select(
        *groups, F.lit(CROP_UNITS[YIELD]).alias("Unit"), yield_of(F.col).alias("Value")
    )


def aggregate(df: DataFrame, element: str, groups: Sequence[str]) -> DataFrame:
    """The element per group: yields are weighted, everything else is summed."""
    return weighted_yield(df, groups) if element == YIELD else sum_by(df, element, groups)


def observation_coverage(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows and values present per group."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n_rows"), F.count("Value").alias("n_values")
    )
