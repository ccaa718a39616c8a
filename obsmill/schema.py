"""The observation model: fixed values, required columns, load-time typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: names, units and factors given by the source data --------
REQUIRED_COLUMNS = ("Area", "Item", "Element", "Year", "Unit", "Value")
M49_COLUMN = "Area Code (M49)"
CPC_COLUMN = "Item Code (CPC)"
MONTHS_COLUMN = "Months"

DOMAINS = {"QCL": "Production", "PP": "Producer prices", "TCL": "Trade"}

PRODUCTION = "Production"
AREA_HARVESTED = "Area harvested"
YIELD = "Yield"
CROP_ELEMENTS = (PRODUCTION, AREA_HARVESTED, YIELD)
CROP_UNITS = {PRODUCTION: "t", AREA_HARVESTED: "ha", YIELD: "kg/ha"}

EXPORT_QUANTITY = "Export quantity"
IMPORT_QUANTITY = "Import quantity"
EXPORT_VALUE = "Export value"
IMPORT_VALUE = "Import value"
TRADE_ELEMENTS = (EXPORT_QUANTITY, IMPORT_QUANTITY, EXPORT_VALUE, IMPORT_VALUE)

PRICE_ELEMENT = "Producer Price (USD/tonne)"
ANNUAL = "Annual value"

YIELD_FACTORS = {"kg/ha": 1.0, "hg/ha": 0.1, "100 mg/ha": 0.0001, "t/ha": 1000.0}

WORLD = "World"
AGGREGATE_CPC_MARK = "F"  # a CPC code holding this letter is a group of crops
SHEET_ROWS = 1_048_575  # rows below the header in one workbook sheet
SCHEMA_VERSION = 3
# -----------------------------------------------------------------------------

KEYS = ("Area", "Item", "Year")
UNCLASSIFIED = "Unclassified"
AGGREGATE_FLAG = "Local aggregate of official observations"


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Refuse a frame that lacks one of the six required columns."""
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"incomplete observation schema, missing {absent}")
    return df


def nan_to_null(col: Column) -> Column:
    """NaN sorts above every number in Spark; missing must be null instead."""
    return F.nullif(col, F.lit(float("nan")))


def typed(df: DataFrame) -> DataFrame:
    """Strict typing: Year to int, Value to double, every other column kept.

    One malformed cell fails the job, whether or not the session is in ANSI mode.
    """
    require_columns(df)

    def strict(name: str, kind: str) -> Column:
        cell, value = F.col(name), F.col(name).try_cast(kind)
        message = F.concat(F.lit(f"{name} is not of type {kind}: "), cell.cast("string"))
        malformed = cell.isNotNull() & value.isNull()
        return F.when(malformed, F.raise_error(message).cast(kind)).otherwise(value)

    return df.withColumns(
        {"Year": strict("Year", "int"), "Value": nan_to_null(strict("Value", "double"))}
    )


def bad_cells(df: DataFrame) -> DataFrame:
    """The rows a strict load would refuse, one row per bad cell."""
    require_columns(df)

    def problem(name: str, kind: str) -> Column:
        text = F.col(name)
        bad = text.isNotNull() & text.try_cast(kind).isNull()
        return F.when(
            bad, F.struct(F.lit(name).alias("column"), text.cast("string").alias("cell"))
        )

    cells = F.array_compact(F.array(problem("Year", "int"), problem("Value", "double")))
    return df.withColumn("_bad", F.explode(cells)).select(
        "*", F.col("_bad.column").alias("bad_column"), F.col("_bad.cell").alias("bad_cell")
    ).drop("_bad")


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))
