"""Connected components of a link table, by rounds of hooking and contraction; the driver sees counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: every node that has a link, with the least node it reaches.

    Each round maps every node of the contracted graph to its least neighbour, shortens these chains to their ends and
    contracts; nodes that are not least among their neighbours vanish, so the graph at least halves.  Sums and minima
    are made on the map side, so a node with a third of all links is no hot key.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    mapping = stage(nodes.select("node", F.col("node").alias("root")), "cc-nodes")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "cc-up")
        while True:  # shorten chains: p(a) becomes p(p(a)) until nothing moves
            over = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            further = stage(up.join(over, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "cc-up")
            up = further.select("a", "p")
            if further.where("moved").isEmpty():
                break
        mapping = stage(mapping.join(up.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-nodes")
        edges = edges.join(up.select("a", F.col("p").alias("pa")), "a").join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = stage(edges.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    return mapping
