"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm.frames import stored


#: The rows of a node meet its smallest neighbour in so many tasks, as a node may have very many links.
SALTS = 16


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Adds the row of `least` to each link of its node."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("salt", salt), ["node", "salt"]).drop("salt")


def _large_star(links: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it."""
    both = links.select("node", "to").unionAll(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("least"))
    moved = _with_least(both.where(F.col("to") > F.col("node")), least)
    return moved.select(F.col("to").alias("node"), F.col("least").alias("to"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("node").agg(F.min("to").alias("least"))
    moved = _with_least(links, least).where(F.col("to") != F.col("least"))
    moved = moved.select(F.col("to").alias("node"), F.col("least").alias("to"))
    return moved.unionAll(least.select("node", F.col("least").alias("to"))).distinct()


def _checksum(links: DataFrame) -> tuple:
    digest: Column = F.sum(F.xxhash64("node", "to").cast("decimal(20,0)"))
    return tuple(links.agg(F.count("*"), digest).first())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, to): each node that isn't the smallest of its component, and that smallest one.

    Alternates two kinds of rounds until nothing changes: the links of a
    component then form a star.  Each round is written to the shared folder,
    which cuts the lineage.  Links to itself and nulls are left out.
    """
    a, b = links.columns
    start = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).distinct()
    found = stored(start, "links")
    before = _checksum(found)
    for _ in range(rounds):
        found = stored(_small_star(_large_star(found)), "links")
        after = _checksum(found)
        if after == before:
            return found
        before = after
    raise RuntimeError(f"components did not settle within {rounds} rounds")
