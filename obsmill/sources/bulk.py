"""Normalised bulk CSV: find it, read every cell as text, type it strictly."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.schema import DOMAINS, require_columns, typed
from obsmill.session import union_all

# Quotes inside a quoted cell are doubled, as spreadsheets and databases write them.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def find_normalized(spark: SparkSession, folder: str) -> str:
    """The single entry of a folder that is named '...normalized....csv', any case.

    An entry is a file, or a directory of part files.  Only names are read.
    """
    folder = folder.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ).select("path")
    # Directory listings come back with a scheme, so look for the folder inside the path.
    below = F.substring_index(F.col("path"), folder.split(":", 1)[-1] + "/", -1)
    entry = F.substring_index(below, "/", 1)
    found = (
        files.select(entry.alias("entry"))
        .where(F.lower("entry").contains("normalized") & F.lower("entry").endswith(".csv"))
        .distinct()
        .limit(2)
        .collect()
    )
    if len(found) != 1:
        raise ValueError(f"expected exactly one normalized CSV in {folder}")
    return f"{folder}/{found[0].entry}"


def read_bulk(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text, in the order of the header; a malformed row fails the load.

    With `multi_line`, quoted cells may hold line breaks; a file is then read
    by one task, as it cannot be split.
    """
    rows = (
        spark.read.options(**CSV_OPTIONS)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", multi_line)
        .csv(path)
    )
    return require_columns(rows)


def load_bulk(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    return typed(read_bulk(spark, find_normalized(spark, folder), multi_line))


def load_domains(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """The bulk CSV of each domain code in one frame with a Domain column."""
    unknown = set(folders) - set(DOMAINS)
    if unknown:
        raise ValueError(f"unknown domains {sorted(unknown)}")
    return domain_union({code: load_bulk(spark, folder) for code, folder in folders.items()})


def domain_union(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All domains in one frame; a column one domain lacks is null there."""
    tagged = [f.withColumn("Domain", F.lit(code)) for code, f in frames.items()]
    return union_all(*tagged, allow_missing=True)


def write_bulk(df: DataFrame, folder: str, name: str) -> str:
    """Writes a frame as a normalised bulk CSV that `load_bulk` reads back."""
    path = f"{folder}/{name}_Normalized.csv"
    df.write.options(**CSV_OPTIONS).csv(path)
    return path
