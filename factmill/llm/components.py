"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.llm.scratch import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one neighbour below it, which has none."""
    ends = edges.select(F.col("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(edges.select(F.col("root").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.min("root").alias("low"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes have equal roots if and only if a path joins them.

    Alternates large stars (each node's larger neighbours are moved to its least neighbour) and small stars (a node and its
    smaller neighbours are moved to the least of them) until only stars are left: the rounds grow with the logarithm of the
    longest path. A round is a fixed number of equi-joins and sums; its tables are written, and those of the
    round before deleted, so neither lineage nor the driver nor the disk grows. A hub's edges are joined
    with a single row of theirs, so a skewed join can be split.
    """
    live = written(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), name)
    while not _stars(live):
        both = live.unionAll(live.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = _lowest(both).select("node", F.least("node", "low").alias("low"))
        large = written(both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).distinct(), name)
        discard(live)
        least = _lowest(large)
        moved = large.join(least, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        live = written(moved.unionAll(least.select("node", F.col("low").alias("root"))).distinct(), name)
        discard(large)
    return live.unionAll(live.select(F.col("root").alias("node"), "root").distinct())
