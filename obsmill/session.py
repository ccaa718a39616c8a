"""Session settings the results depend on."""

from __future__ import annotations

import os
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def sound_unions(spark: SparkSession) -> None:
    """Turns off partition-aware unions, which give wrong sums in Spark 4.1.

    With them on, an aggregate over a union of two frames that are partitioned
    by the same key may skip its shuffle although the union is not partitioned
    that way; a key then comes out as two groups.  test_sources.py has a case.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def union_all(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    sound_unions(frames[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the batches that go to Python workers, unless the application sets a bound.

    A task holds some batches at once, in the JVM outside the heap as well as
    in the worker; ten thousand texts are some tens of megabytes.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(bound):
        spark.conf.set(bound, "4m")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed but lies in a shared checkout."""
    place, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if place not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, place])
