"""Connected components of a table of links, by alternating stars.

Each round turns every node's links to the least node among its neighbours, first for
larger neighbours, then for smaller ones, which halves distances while the number of
links, repeated ones included, does not grow. Rounds end as soon as stars are left. Nothing
leaves the cluster but one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tokentide.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    # Written, so that the join reads plain shuffles, of which Spark can split a hot node.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = both.where("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m"))


def _stars(links: DataFrame) -> bool:
    """Whether every a has one link alone and no b is an a, as when all nodes point to their root."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return held.where("below > 1 OR (below = 1 AND above = 1)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the least node of the component.

    ``links`` has integer columns a and b and is read three times. Links of a node with itself and
    those with a null end are ignored; repeated links count once. Without links the result is empty.
    """
    state = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        # Written, as the next star reads it twice.
        large = materialize(_large_star(state), "large")
        state = materialize(_small_star(large), "links")
        if _stars(state):
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def ends(pointers: DataFrame) -> DataFrame:
    """(node, root) of each node, where its path of ``pointers`` (node, root) ends.

    A node has one pointer at most, and no path may come back to where it was. Paths halve in each round.
    """
    state = pointers.select("node", "root")
    while True:
        after = state.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = state.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "next")
        moved = materialize(moved, "ends")
        state = moved.select("node", "root")
        if moved.where("next IS NOT NULL").isEmpty():
            return state
