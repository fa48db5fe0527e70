"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.stored import release, stored

ROWS_A_TASK = 200_000


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (columns ``a`` and ``b``, longs).

    Each round points the larger neighbours of every node, then its smaller ones, at the smallest of them;
    when only stars are left, every node points at its component.  Minima are summed up per task before a shuffle,
    and joins on a node with very many links are split by adaptive execution.  Rounds are stored, so a lost
    executor repeats one round at most.  Without links the result is empty.
    """

    def lowest(both: DataFrame) -> DataFrame:
        return both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))

    def state(frame: DataFrame) -> tuple[int, int]:
        """How many links there are, and how many nodes that are not yet the middle or a tip of a star."""
        tips = frame.select(F.col("a").alias("node"), F.lit(1).alias("tip"), F.lit(0).alias("middle"))
        middles = frame.select(F.col("b").alias("node"), F.lit(0).alias("tip"), F.lit(1).alias("middle"))
        nodes = tips.unionByName(middles).groupBy("node").agg(F.sum("tip").alias("tip"), F.max("middle").alias("middle"))
        open_nodes = F.count_if((F.col("tip") > 1) | ((F.col("tip") > 0) & (F.col("middle") > 0)))
        found = nodes.agg(F.sum("tip"), open_nodes).first()
        return found[0] or 0, found[1]

    # Every pair points from the larger to the smaller node.
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows, unsettled = state(now)
    while unsettled:
        # Rounds shrink the links; a few rows need no more tasks than this.
        now = now.coalesce(1 + rows // ROWS_A_TASK)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(lowest(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a <> b")
        lows = lowest(large)
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        pointed = small.unionByName(lows.select("a", F.col("low").alias("b")))
        now = stored(pointed.filter("a <> b").distinct())
        # Else the driver's heap fills up with what it held for the jobs of all rounds.
        release(links.sparkSession)
        rows, unsettled = state(now)
    release(links.sparkSession)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
