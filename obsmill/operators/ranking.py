"""Ranks with ties, shares and top rows, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsmill.functions.values import exact_sum, value_ladder
from obsmill.session import union_all


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, as they do in groupBy."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


# A value bucket is sorted in one task unless it has more rows than this and
# also more than one in CROWDED_SHARE of all rows.
CROWDED = 1_000_000
CROWDED_SHARE = 100_000


def _rows_above(within: Sequence[str], bucket: str) -> Column:
    """Running number of rows in higher buckets, for a frame with a row count `_n` per bucket."""
    above = (
        Window.partitionBy(*within)
        .orderBy(F.col(bucket).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("_n").over(above), F.lit(0))


def with_rank(
    df: DataFrame, by: Sequence[str], value: str = "Value", small: bool = False
) -> DataFrame:
    """Adds `rank`: ties share a position and the next one skips; nulls are dropped.

    `small` is the caller's promise that a group is bounded whatever the data,
    such as one row per country; then one plain window does it.  Otherwise no group is gathered: its values fall into
    order-keeping buckets, and a rank is the rows in higher buckets plus the
    rank inside the own one.  A crowded bucket (many equal or close values) is
    counted per value instead of sorted, by finer buckets.  So a window runs
    over a few million entries, or over a share of the rows that any task has.
    """
    rows = df.where(F.col(value).isNotNull())
    highest_first = F.col(value).desc()
    if small:
        group = Window.partitionBy(*(list(by) or [F.lit(1)]))
        return rows.withColumn("rank", F.rank().over(group.orderBy(highest_first)).cast("bigint"))

    # In a struct null keys are equal, as they are in groupBy.
    group_key = F.struct(*[F.col(f"`{c}`") for c in by], F.lit(1).alias("_"))
    coarse, fine = value_ladder(F.col(value))
    rows = rows.withColumns({"_group": group_key, "_coarse": coarse})
    bucket = ["_group", "_coarse"]
    sizes = rows.groupBy(*bucket).agg(F.count("*").alias("_n"))
    buckets = sizes.withColumn("_above", _rows_above(["_group"], "_coarse"))
    limit = F.greatest(F.lit(CROWDED), sizes.agg(F.sum("_n")).scalar() / CROWDED_SHARE)
    # Fewer than CROWDED_SHARE buckets can be above the limit: safe to broadcast.
    crowded = F.broadcast(buckets.where(F.col("_n") > limit).drop("_n"))

    inside = F.rank().over(Window.partitionBy(*bucket).orderBy(highest_first))
    sorted_rows = (
        rows.join(crowded, bucket, "left_anti")
        .join(buckets.drop("_n"), bucket)
        .withColumn("rank", F.col("_above") + inside)
    )

    counted = rows.join(crowded, bucket)
    values = (
        counted.groupBy(*bucket, value)
        .agg(F.count("*").alias("_n"))
        .withColumn("_fine", fine)
    )
    finer = (
        values.groupBy(*bucket, "_fine")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_above_fine", _rows_above(bucket, "_fine"))
        .drop("_n")
    )
    values = (
        values.withColumn("_above_value", _rows_above([*bucket, "_fine"], value))
        .join(finer, [*bucket, "_fine"])
        .drop("_fine", "_n")
    )
    above = F.col("_above") + F.col("_above_fine") + F.col("_above_value")
    counted_rows = counted.join(values, [*bucket, value]).withColumn("rank", above + 1)

    columns = [*[F.col(f"`{c}`") for c in df.columns], F.col("rank").cast("bigint").alias("rank")]
    return union_all(sorted_rows.select(*columns), counted_rows.select(*columns))


def with_share(
    df: DataFrame,
    by: Sequence[str],
    value: str = "Value",
    small: bool = False,
    population: DataFrame | None = None,
) -> DataFrame:
    """Adds `share_pct` of the group total; null when the total is missing or not positive.

    The total is that of `population`, by default the rows themselves.
    """
    by = list(by)
    if small:
        group = Window.partitionBy(*(by or [F.lit(1)]))
        total = exact_sum(F.col(value), group)
        return df.withColumn("share_pct", F.when(total > 0, F.col(value) / total * 100))
    population = df if population is None else population
    if not by:
        by = ["_all"]
        df, population = (frame.withColumn("_all", F.lit(1)) for frame in (df, population))
    totals = population.groupBy(*by).agg(exact_sum(F.col(value)).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total") * 100)
    return match_keys(df, totals, by).withColumn("share_pct", share).drop("_total", "_all")


def shares_and_ranks(df: DataFrame, by: Sequence[str], small: bool = False) -> DataFrame:
    """Rank and share of every row within its group, over the whole population."""
    present = df.where(F.col("Value").isNotNull())
    # The totals come from the rows before ranking, so the ranking is planned once.
    ranked = with_rank(present, by, small=small)
    return with_share(ranked, by, small=small, population=present)


def top_rows(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group's ranking; a tie at the cut goes by Area.

    The row-number limit is applied inside each map task first, so at most n
    rows per group and task are shuffled.  All rows above a kept row are kept,
    so the rank among the kept rows is the rank in the population.
    """
    keys = list(by) or [F.lit(1)]
    order = [F.col("Value").desc(), F.col("Area").asc_nulls_last()]
    first = (
        df.where(F.col("Value").isNotNull())
        .withColumn("_position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_position") <= n)
    )
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("Value").desc()))
    return first.withColumn("rank", rank.cast("bigint")).drop("_position")


def top_area(df: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Area with the greatest value per group, and the columns to keep of its row.

    Equal values go to the first Area.
    """
    best = F.min(F.struct((-F.col("Value")).alias("v"), "Area", *keep))
    return (
        df.where(F.col("Value").isNotNull())
        .groupBy(*by)
        .agg(best.alias("_best"))
        .select(
            *by, "_best.Area", (-F.col("_best.v")).alias("Value"), *[f"_best.{c}" for c in keep]
        )
    )


def rank_of(df: DataFrame, area: str, by: Sequence[str]) -> DataFrame:
    """Rank of one area per group: one more than the number of greater values."""
    present = df.where(F.col("Value").isNotNull())
    own = present.where(F.col("Area") == area).select(*by, F.col("Value").alias("_own"))
    greater = F.count(F.when(F.col("Value") > F.col("_own"), 1))
    return match_keys(present, own, by).groupBy(*by).agg((greater + 1).alias("rank"))
