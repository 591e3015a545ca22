"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected edge list of longs; root is the component's smallest node.

    Edges that name a null or join a node to itself say nothing. Each round
    hangs every node's larger neighbours below its smallest one, then its
    smaller neighbours too; neighbours are joined to an aggregated minimum, so
    no neighbour list is ever held in one row. Rounds are written tables.
    """
    up, down = F.greatest(a, b), F.least(a, b)
    tree = written(edges.where(F.col(a) != F.col(b)).select(up.alias("u"), down.alias("v")).distinct())
    before = None
    while True:
        now = tree.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now or not now[0]:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tree.select("v", "v").distinct())
        before = now
        both = tree.union(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
