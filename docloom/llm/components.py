"""Connected components by alternating large-star and small-star, on links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, saved

MOST_ROUNDS = 60


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v) to the least neighbour instead: of a node's larger neighbours (large), or of its smaller ones and itself.

    The least neighbour comes by a grouped minimum, not by gathering a node's neighbours, so a node with many stays split
    over tasks before the exchange. The minima are written out, so that the join reads plain exchanges on both sides: only
    such a join lets adaptive execution split a node with very many links.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = saved(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node that has a link to another.

    links: a and b, of one orderable type; nulls and self-links are left aside; repeated links and either direction count
    once. No links: no rows. Each half round is written to the shared folder, so a plan holds one only, and what a round
    has read is deleted when it is over.
    """
    now = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        """Changes whenever the set of links changes: the count, and two sums of hashes."""
        wide = T.DecimalType(38, 0)
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast(wide)), F.sum(F.xxhash64(F.lit(7), "v", "u").cast(wide))).first())

    before = mark(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        half = saved(_stars(now, large=True), "links")
        after = saved(_stars(half, large=False), "links")
        dropped(now)
        dropped(half)
        now, told = after, mark(after)
        if told == before:
            break
        before = told
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
