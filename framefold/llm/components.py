"""Connected components of an edge table by contraction; no edge or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to one row (node, root) per node, root being the smallest node of its component.

    Each round points every node to its smallest neighbour, follows the pointers twice and replaces the edges' ends;
    loops and repeats go, so the edges shrink until none is left.  Minima are combined before they are shuffled,
    and every table is written, so that joins see the hot node's rows as a partition that can be split.
    """
    left = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        near = materialize(near.select("node", F.least("node", "to").alias("to")))
        step = near.select(F.col("node").alias("to"), F.col("to").alias("next"))
        near = materialize(near.join(step, "to").select("node", F.col("next").alias("to")))
        if found is None:
            found = near.select("node", F.col("to").alias("root"))
        else:  # roots of before that are still nodes of an edge move on
            moved = near.select(F.col("node").alias("root"), "to")
            found = materialize(found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        at_a = near.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        at_b = near.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        ends = left.join(at_a, "a").join(at_b, "b").where("to_a <> to_b")
        left = materialize(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
