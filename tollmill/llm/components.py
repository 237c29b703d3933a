"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollmill.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node links its larger (or its smaller) neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # a side of its own, so that a node with very many neighbours can be split in the join
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if large:
        linked = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (u, v) edges can reach. Nodes are longs."""
    down = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = stored(down, "edges")
    if down.isEmpty():
        return down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        turned = _star(down, large=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = stored(_star(stored(turned, "edges"), large=False), "edges")
        # done when every node but the roots has one edge, and it leads to a root
        ends = down.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            down.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        ).groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.filter((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1))).isEmpty():
            break
    roots = down.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
