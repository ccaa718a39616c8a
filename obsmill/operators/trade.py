"""Trade flows; a flow that is not reported is missing, not zero."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.functions.values import exact_sum
from obsmill.schema import EXPORT_VALUE, IMPORT_VALUE

BALANCE_KEYS = ("Area", "Item", "Year", "Unit")


def _all_present(names) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in names])


def trade_balance(df: DataFrame) -> DataFrame:
    """Export value minus import value; null when one side is not reported.

    Conditional sums in one aggregation: the two flows are known beforehand,
    so no pivot job is needed.
    """

    def flow(element: str) -> Column:
        return exact_sum(F.when(F.col("Element") == element, F.col("Value")))

    return (
        df.where(F.col("Element").isin(EXPORT_VALUE, IMPORT_VALUE) & _all_present(BALANCE_KEYS))
        .groupBy(*BALANCE_KEYS)
        .agg(flow(EXPORT_VALUE).alias("export_value"), flow(IMPORT_VALUE).alias("import_value"))
        .where(F.coalesce("export_value", "import_value").isNotNull())
        .withColumn("trade_balance", F.col("export_value") - F.col("import_value"))
    )


def trade_by_item(df: DataFrame) -> DataFrame:
    """Each flow by item, year and unit; rows with a missing key are left out."""
    keys = ("Element", "Item", "Year", "Unit")
    return (
        df.where(_all_present(keys)).groupBy(*keys).agg(exact_sum(F.col("Value")).alias("Value"))
    )
