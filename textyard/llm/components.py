"""Connected components of an edge table, as Spark jobs only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textyard.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge ``(a, b)``; nodes share a root if and only if they are connected.

    Each round every node is merged into the neighbour, or itself, that comes first in an order drawn anew
    for the round, so paths shrink by a share of their length whatever their ids. The number of rounds grows
    with the logarithm of the longest path. Null ends and loops are ignored.
    """
    live = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while not live.isEmpty():
        seed = len(levels) + 1
        both = live.union(live.select("b", "a"))
        key = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("v"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(key("b")).alias("other"))
        up = stored(best.select("node", F.least("other", key("node"))["v"].alias("parent")))
        levels.append(up)
        moved = (
            live.join(up.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
        )
        live = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not levels:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = levels[-1].select("node", F.col("parent").alias("root"))
    for up in reversed(levels[:-1]):
        above = roots.select(F.col("node").alias("parent"), "root")
        roots = up.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
