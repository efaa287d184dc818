"""Connected components on tables, in a number of rounds logarithmic in the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of every node of ``links (a, b)``.

    Every node has a parent, at first its least neighbour or itself. In a round a
    node and its parent move to the least grandparent among the node's neighbours
    and to their own; so trees hook onto smaller ones and their paths halve. Nodes
    are joined with one row per node and least values are taken by aggregation, so
    a node with very many links is split or combined before it moves. The loop ends
    when no parent changes.
    """
    a, b = F.col("a"), F.col("b")
    both = links.where("a <> b").select("a", "b")
    edges = materialize(both.unionByName(both.select(b.alias("a"), a.alias("b"))).distinct(), "component-edges")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    hooked = edges.groupBy(a.alias("node")).agg(F.min("b").alias("least"))
    parents = materialize(
        ends.join(hooked, "node", "left").select("node", F.least("node", "least").alias("parent")), "component-parents"
    )
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
        known = materialize(parents.join(above, "parent").select("node", "parent", "grandparent"), "component-grandparents")
        near = edges.join(known.select(F.col("node").alias("b"), "grandparent"), "b").groupBy(a.alias("node")).agg(
            F.min("grandparent").alias("near")
        )
        offered = known.join(near, "node", "left").select("node", "parent", F.least("grandparent", "near").alias("offer"))
        own = offered.select("node", F.col("offer").alias("to"), F.col("parent").alias("was"))
        hook = offered.select(F.col("parent").alias("node"), F.col("offer").alias("to"), F.lit(None).alias("was"))
        moved = materialize(
            own.unionByName(hook).groupBy("node").agg(F.min("to").alias("parent"), F.min("was").alias("was")), "component-moves"
        )
        parents = moved.select("node", "parent")
        if moved.where("parent <> was").isEmpty():
            return parents.select("node", F.col("parent").alias("component"))
