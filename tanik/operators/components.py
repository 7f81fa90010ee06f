"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tanik.session import saved, settled


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches; only nodes of ``edges`` appear.

    Each round gives every node its smallest neighbour or itself as parent, follows parents by doubling
    until all point to roots, and contracts the edges to roots; at least half of the linked nodes go each
    round. The smallest node of a component is always its own parent, so it is the one that remains. All
    steps are grouped minima and equi-joins: a node with very many edges is pre-aggregated before the
    shuffle. What the rounds pass on has measured sizes, so planning stays as cheap in the last round as in
    the first.
    Null ends and self-loops link nothing (a node that has only a self-loop is its own component).
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = saved(pairs.distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select("node", F.col("node").alias("component"))
    live = pairs.where("a <> b")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        parents = both.groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        parents = settled(parents)
        while True:
            jump = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = settled(parents.select("a", "p").join(jump, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            parents = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        nodes = settled(nodes.join(parents.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        to = lambda side: parents.select(F.col("a").alias(side), F.col("p").alias(f"p{side}"))
        live = settled(live.join(to("a"), "a").join(to("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    return nodes
