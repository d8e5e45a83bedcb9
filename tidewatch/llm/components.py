"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch


def _order(node: Column) -> Column:
    """Random but fixed order of the nodes, so that a long chain shrinks by a
    constant factor in each round."""
    return F.struct(F.xxhash64(node).alias("h"), node.alias("v"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns ``a``, ``b``).

    Each round gives every node its first neighbour (or itself) in a random
    order and moves the edges there; loops and repeats go. Rounds grow with
    the logarithm of the longest chain. Each round is written to the shared
    folder; only whether edges are left comes to the driver. Self-loops give
    a node of its own; an empty table gives an empty result.
    """
    edges = scratch.put(edges.select("a", "b").distinct(), "edges")
    roots = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        first = both.groupBy("a").agg(F.min(_order(F.col("b"))).alias("m"))
        step = scratch.put(first.select(F.col("a").alias("node"), F.least(_order(F.col("a")), F.col("m")).v.alias("root")), "step")
        if roots is None:
            roots = step
        else:
            new = roots.alias("r").join(step.alias("s"), F.col("r.root") == F.col("s.node"), "left").select(
                "r.node", F.coalesce("s.root", "r.root").alias("root"))
            roots = scratch.put(new, "roots")
        moved = (edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
                 .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
                 .where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        edges = scratch.put(moved, "edges")
        if edges.isEmpty():
            return roots
