"""The catalog of published domains (a nested JSON document) and its checks."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.schema import DOMAINS

# Fixed value: the layout of the catalog document.
CATALOG_SCHEMA = (
    "Datasets struct<Dataset: array<struct<"
    "DatasetCode: string, DatasetName: string, DateUpdate: string, FileLocation: string>>>"
)
UNKNOWN_DATE = "Not stated"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    """Host of a URL, lower case, without user and port; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)", 1))


def accepted_url(url: Column, host: str) -> Column:
    """Only https and the one given host pass."""
    return F.coalesce((url_scheme(url) == "https") & (url_host(url) == host), F.lit(False))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per data set, with default name and date; a malformed catalog is an error."""
    documents = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    broken = documents.where(F.col("Datasets.Dataset").isNull()).limit(1)
    if documents.isEmpty() or not broken.isEmpty():
        raise ValueError(f"malformed catalog {path}: Datasets.Dataset is not a list")
    row = documents.select(F.explode("Datasets.Dataset").alias("d"))
    name = F.col("d.DatasetName")
    for code, title in DOMAINS.items():
        name = F.coalesce(name, F.when(F.col("d.DatasetCode") == code, F.lit(title)))
    return row.select(
        F.col("d.DatasetCode").alias("code"),
        name.alias("name"),
        F.coalesce("d.DateUpdate", F.lit(UNKNOWN_DATE)).alias("updated"),
        F.coalesce("d.FileLocation", F.lit("")).alias("url"),
    )


def current_catalog(spark: SparkSession, fresh: str, stored: str | None = None) -> DataFrame:
    """The fresh catalog, or with a warning the stored good one when the fresh one is bad."""
    try:
        return read_catalog(spark, fresh)
    except Exception as problem:
        if stored is None:
            raise ValueError(f"no catalog can be read: {problem}") from problem
        warnings.warn(f"catalog not refreshed, the stored copy is used: {problem}")
        return read_catalog(spark, stored)


def domain_metadata(catalog: DataFrame, code: str, host: str) -> dict[str, str]:
    """Metadata of one domain; unknown codes, absent rows and foreign URLs are refused."""
    if code not in DOMAINS:
        raise ValueError(f"unknown domain {code}")
    rows = (
        catalog.where(F.col("code") == code)
        .withColumn("accepted", accepted_url(F.col("url"), host))
        .limit(1)
        .collect()
    )
    if not rows:
        raise ValueError(f"domain {code} is not in the catalog")
    if not rows[0].accepted:
        raise ValueError(f"domain {code} is not served over https by {host}")
    return {c: rows[0][c] for c in ("code", "name", "updated", "url")}


def stale_domains(catalog: DataFrame, releases: DataFrame) -> DataFrame:
    """Known domains whose catalog date differs from the date of the prepared release.

    A catalog lists many data sets besides; those are none of a release's concern.
    """
    catalog = catalog.where(F.col("code").isin(*DOMAINS))
    held = releases.select("code", F.col("updated").alias("release_updated"))
    return catalog.join(held, "code", "left").select(
        "code",
        F.col("updated").alias("catalog_updated"),
        "release_updated",
        (~F.col("updated").eqNullSafe(F.col("release_updated"))).alias("stale"),
    )
