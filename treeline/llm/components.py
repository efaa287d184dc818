"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.store import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, least``: the least neighbour of ``u`` beside each.

    Both sides of the join are tables, so AQE may split a node of many edges.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("least")), "least")
    return edges.join(least, "u")


def _downwards(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _all_stars(edges: DataFrame) -> bool:
    """Does every node point at one node, which points at none?"""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_aim")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("is_aim")),
    )).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("is_aim").alias("is_aim"))
    return seen.where("points > 1 or (points = 1 and is_aim = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for the nodes of ``links (a, b)``.

    Every round points each node's larger neighbours, then all its neighbours, at
    the least one; chains shrink by halves and no node gathers its neighbours.
    """
    u, v, least = F.col("u"), F.col("v"), F.col("least")
    edges = stored(links.where("a <> b").select(*_downwards(F.col("a"), F.col("b"))).distinct(), "edges")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        large = stored(_with_least(both).where(v > u).select(v.alias("u"), F.least(u, least).alias("v")), "large-star")
        small = _with_least(large)
        pointed = small.where(v != least).select(v.alias("u"), least.alias("v")).unionByName(
            small.select(u.alias("u"), least.alias("v"))
        )
        edges = stored(pointed.distinct(), "small-star")
    stars = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).unionByName(stars)
