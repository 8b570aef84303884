"""Connected components by contraction, in a few rounds of joins.

Each round points every node to its smallest neighbour (if smaller), follows the pointers
to their end by doubling, and replaces nodes by these ends; what is left are edges between
ends. Every step is a stored table, so a lost executor costs one step. Neighbours are
reduced to a minimum with partial sums, so a node with very many edges is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def followed(m: DataFrame) -> DataFrame:
    """Pointers (node, parent) without cycles, followed to their ends; stored."""
    while True:
        up = m.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        m = stored(m.join(up, "parent", "left").select(
            "node", F.coalesce("_up", "parent").alias("parent"),
            (F.coalesce("_up", "parent") != F.col("parent")).alias("_moved")))
        moved = not m.where("_moved").isEmpty()
        m = m.drop("_moved")
        if not moved:
            return m


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the smallest node.

    Edges may repeat, lie in either direction and join a node with itself; nulls are left
    out. No edges: no rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    whole = None
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        m = stored(both.groupBy("node").agg(F.min("other").alias("other"))
                   .select("node", F.least("node", "other").alias("parent")))
        m = followed(m)
        if whole is None:
            whole = m
        else:
            up = m.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            whole = stored(whole.join(up, "parent", "left")
                           .select("node", F.coalesce("_up", "parent").alias("parent")))
        ends = m.select(F.col("node"), F.col("parent"))
        e = stored(e.join(ends.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
                   .join(ends.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
                   .where("pa != pb")
                   .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if e.isEmpty():
            return whole.select("node", F.col("parent").alias("root"))
