"""Connected components of an edge table, by alternating stars.

Every round joins each node's neighbours to their smallest neighbour (large star), then the smaller
neighbours of each node to the smallest of them (small star), until the edges are stars around the
smallest node of each component. Smallest neighbours are pre-aggregated; they are joined back, so a
node with very many edges is a skewed join that adaptive execution can split, never one group in one
task. The edges of a round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.session import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """(node, smallest neighbour) for the larger or for the smaller neighbours of each node."""
    around = _both_ways(edges)
    if not larger:
        around = around.where("b < a")
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = around.join(least, "a")
    if larger:
        linked = linked.where("b > a")
        new = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return new.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; `edges` has columns a and b of one type.

    The root is the smallest node of the component. Loops and nulls are ignored.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(ends.where("a <> b").distinct())
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    while True:
        seen = now.agg(F.count("*"), mark).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        now = stage(_star(_star(now, larger=True), larger=False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
