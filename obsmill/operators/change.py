"""Change over time; the earlier year must be there, no nearer one stands in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsmill.functions.values import compound_growth, percent_change


def yoy_change(yearly: DataFrame, series: Sequence[str]) -> DataFrame:
    """Change against exactly the year before, for one row per series and Year.

    A window partition is one series, so it has as many rows as there are years.
    """
    order = Window.partitionBy(*(list(series) or [F.lit(1)])).orderBy("Year")
    adjacent = F.lag("Year").over(order) == F.col("Year") - 1
    return yearly.withColumn("previous", F.when(adjacent, F.lag("Value").over(order))).withColumn(
        "change_pct", percent_change(F.col("Value"), F.col("previous"))
    )


def _ends(yearly: DataFrame, series: Sequence[str]) -> DataFrame:
    return (
        yearly.where(F.col("Value").isNotNull())
        .groupBy(*series)
        .agg(
            F.min("Year").alias("first_year"),
            F.max("Year").alias("last_year"),
            F.min_by("Value", "Year").alias("first_value"),
            F.max_by("Value", "Year").alias("last_value"),
            F.count("*").alias("n_years"),
            F.min("Unit").alias("_unit_min"),
            F.max("Unit").alias("_unit_max"),
        )
        .withColumn("one_unit", F.col("_unit_min").eqNullSafe(F.col("_unit_max")))
        .drop("_unit_min", "_unit_max")
    )


def period_change(yearly: DataFrame, series: Sequence[str]) -> DataFrame:
    """First to last year with a value; needs two years and a single unit."""
    change = percent_change(F.col("last_value"), F.col("first_value"))
    enough = (F.col("n_years") > 1) & F.col("one_unit")
    return _ends(yearly, series).withColumn("change_pct", F.when(enough, change)).drop("one_unit")


def series_growth(yearly: DataFrame, series: Sequence[str]) -> DataFrame:
    """Yearly growth rate between the first and the last year with a value."""
    span = F.col("last_year") - F.col("first_year")
    rate = compound_growth(F.col("first_value"), F.col("last_value"), span)
    return _ends(yearly, series).withColumn("cagr_pct", F.when(F.col("one_unit"), rate)).drop(
        "one_unit"
    )
