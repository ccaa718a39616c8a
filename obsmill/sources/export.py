"""Spreadsheet-safe exports and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsmill.functions.text import formula_safe
from obsmill.operators.ranking import match_keys
from obsmill.operators.selection import canonical_order
from obsmill.schema import DOMAINS, SHEET_ROWS
from obsmill.sources.workspace import new_folder

BYTE_ORDER_MARK = "\ufeff"


def safe_cells(df: DataFrame) -> DataFrame:
    """Every text column made safe for spreadsheets; other columns unchanged."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: formula_safe(F.col(f"`{c}`")) for c in text})


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = True) -> None:
    """Safe CSV with header, missing as empty.

    Every part file has its own header, so putting the mark before the first
    column name makes each part a complete file for a spreadsheet.
    """
    safe = safe_cells(df)
    if byte_order_mark:
        first = safe.columns[0]
        safe = safe.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    safe.write.options(header=True, nullValue="", emptyValue="", quote='"', escape='"').csv(path)


SHEET_OPTIONS = {"header": True, "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"'}
# Spaces around a cell belong to it.
NAMED_OPTIONS = {**SHEET_OPTIONS, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
SHEET = "sheet"


def write_sheets(
    df: DataFrame, path: str, limit: int = SHEET_ROWS, codes: Sequence[str] = tuple(DOMAINS)
) -> None:
    """One folder per domain, in canonical order, no file longer than a sheet.

    A domain without rows gets one sheet with the header alone.  The whole row
    takes part in the range key, so equal keys spread over tasks.
    """
    safe = safe_cells(df)
    (
        safe.repartitionByRange(
            "Domain", "Area", "Item", "Element", "Year", F.xxhash64(*[f"`{c}`" for c in df.columns])
        )
        .sortWithinPartitions("Domain", *canonical_order())
        .write.option("maxRecordsPerFile", limit)
        .options(**SHEET_OPTIONS)
        .partitionBy("Domain")
        .csv(path)
    )
    present = {r.Domain for r in df.select("Domain").distinct().collect()}  # a few codes
    for code in codes:
        if code not in present:
            safe.drop("Domain").limit(0).write.options(**SHEET_OPTIONS).csv(f"{path}/Domain={code}")


def export_parts(df: DataFrame, limit: int = SHEET_ROWS, codes: Sequence[str] = tuple(DOMAINS)) -> DataFrame:
    """Sheets each domain needs and the rows in each; an empty domain has one empty sheet.

    Follows from the row counts alone, so no row has to be numbered.
    """
    every = df.sparkSession.createDataFrame([(c,) for c in codes], "Domain string")
    counts = df.groupBy("Domain").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    sheets = F.greatest(F.ceil(n / F.lit(limit)), F.lit(1)).cast("int")
    return (
        every.join(counts, "Domain", "left")
        .select("Domain", n.alias("_n"), F.explode(F.sequence(F.lit(1), sheets)).alias("part"))
        .select(
            "Domain",
            "part",
            F.concat("Domain", F.lit("_"), F.col("part").cast("string")).alias("sheet"),
            F.least(F.col("_n") - (F.col("part") - 1).cast("bigint") * limit, F.lit(limit)).alias("n_rows"),
        )
    )


def named_sheets(df: DataFrame, limit: int = SHEET_ROWS) -> DataFrame:
    """Safe rows with the sheet each belongs to, CODE_1, CODE_2 and so on, and `_at`, its place in the domain from 0.

    Sheets are filled in canonical order, rows that are equal there by their
    other columns.  Rows are sorted by range and numbered within their task;
    what lies before a task follows from one count per task and domain, so no
    domain passes through one task.  The sorted rows are written once, as
    numbers must not change when a task is run again.
    """
    if SHEET in df.columns:
        raise ValueError(f"a column named {SHEET} would be lost")
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in ("Domain", "Area", "Item", "Element", "Year")]
    order = [F.col("Domain").asc_nulls_last(), *canonical_order(), *rest]
    ranged = safe_cells(df).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    folder = new_folder(df.sparkSession, "sheet-rows")
    numbered.write.parquet(folder)
    rows = df.sparkSession.read.schema(numbered.schema).parquet(folder)
    tasks = rows.groupBy("Domain", "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("Domain").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("Domain", "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_row") - F.col("_first")
    part = F.expr(f"_at div {int(limit)} + 1").cast("string")
    placed = match_keys(rows, starts, ["Domain", "_task"]).withColumn("_at", at)
    return placed.withColumn(SHEET, F.concat("Domain", F.lit("_"), part)).select(*[f"`{c}`" for c in df.columns], SHEET, "_at")


def write_named_sheets(
    df: DataFrame, path: str, limit: int = SHEET_ROWS, codes: Sequence[str] = tuple(DOMAINS)
) -> None:
    """One file per sheet, in a folder that carries the sheet's name.

    A sheet has at most `limit` rows, so one task writes it.  A domain without
    rows gets one sheet with the header alone; rows without a domain share the
    folder of the missing name.
    """
    rows = named_sheets(df, limit)
    ordered = rows.repartition(SHEET).sortWithinPartitions(SHEET, "_at").drop("_at", "Domain")
    ordered.write.options(**NAMED_OPTIONS).partitionBy(SHEET).csv(path)
    present = {r.Domain for r in df.select("Domain").distinct().collect()}  # a few codes
    for code in codes:
        if code not in present:
            empty = safe_cells(df).drop("Domain").limit(0)
            empty.write.options(**NAMED_OPTIONS).csv(f"{path}/{SHEET}={code}_1")


def read_named_sheets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of written sheets with the name of their sheet and, as `file`, that of their file.

    `schema` is that of the table that was written; the domain comes from the
    sheet's name.  Cells may hold line breaks, so a file is read by one task.
    """
    cells = T.StructType([f for f in schema.fields if f.name != "Domain"])
    named = T.StructType([*cells.fields, T.StructField(SHEET, T.StringType())])
    options = {"header": True, "enforceSchema": True, "quote": '"', "escape": '"', "multiLine": True}
    rows = spark.read.schema(named).options(**options).csv(path)
    domain = F.regexp_extract(SHEET, r"^(.*)_\d+$", 1)
    return rows.select(domain.alias("Domain"), "*", F.col("_metadata.file_name").alias("file"))


def sheet_report(rows: DataFrame) -> DataFrame:
    """What was read back of each sheet: files, rows, and the bounds of its contents."""
    return rows.groupBy("Domain", SHEET).agg(
        F.count_distinct("file").alias("n_files"),
        F.count("*").alias("n_rows"),
        F.count("Value").alias("n_values"),
        F.min("Area").alias("first_area"),
        F.max("Area").alias("last_area"),
        F.min("Value").alias("least"),
        F.max("Value").alias("greatest"),
    )


def provenance(
    metadata: DataFrame, years: tuple[int, int], areas: Sequence[str], items: Sequence[str]
) -> DataFrame:
    """Metadata of each domain together with the selection it was exported under."""
    return metadata.withColumns(
        {
            "period": F.lit(f"{years[0]}–{years[1]}"),
            "areas": F.lit(", ".join(areas)),
            "items": F.lit(", ".join(items)),
        }
    )


def domain_summary(metadata: DataFrame) -> DataFrame:
    return metadata.select("code", "name", "updated", "source", "rows")
