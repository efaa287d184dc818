"""Strongly connected components and elementary cycles of a directed graph, by joins with its edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from treeline.session import materialize

_HOPS = 3  # edges that values cross between two tables


def _peel(edges: DataFrame) -> DataFrame:
    """Drop edges that enter a node nothing leaves or leave a node nothing enters, until none is left.

    Such edges lie on no cycle; a graph without cycles loses all of them.
    """
    before, left = None, edges.count()
    while left != before and left:
        sources = edges.select("repo", F.col("src").alias("dst")).distinct()
        targets = edges.select("repo", F.col("dst").alias("src")).distinct()
        kept = edges.join(sources, ["repo", "dst"], "left_semi").join(targets, ["repo", "src"], "left_semi")
        edges = materialize(kept.select("repo", "src", "dst"), "cycle-edges")
        before, left = left, edges.count()
    return edges


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, node, value``: the least value of a node and of all nodes that reach it."""
    while True:
        spread = values
        for _ in range(_HOPS):
            offered = edges.join(spread.withColumnRenamed("node", "src"), ["repo", "src"]).select(
                "repo", F.col("dst").alias("node"), "value"
            )
            spread = spread.unionByName(offered).groupBy("repo", "node").agg(F.min("value").alias("value"))
        before = values.withColumnRenamed("value", "before")
        spread = materialize(spread.join(before, ["repo", "node"]), "cycle-values")
        values = spread.select("repo", "node", "value")
        if spread.where("value < before").isEmpty():
            return values


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.explode(F.array("src", "dst")).alias("node")).distinct()


def strong_components(edges: DataFrame) -> DataFrame:
    """``repo, node, component`` (its least node) of nodes that lie on a cycle with another node.

    Nodes on no cycle are trimmed. Then every node takes the least node that reaches
    it as its colour; of a colour, the nodes that lead back to that least node are
    its component. Edges between colours lie on no cycle and go, with those of the
    found components, until no edge is left. Components on one path of components
    may need a round each, and values cross three edges between two tables.
    """
    left = materialize(edges.select("repo", "src", "dst").where("src <> dst").distinct(), "cycle-edges")
    found = None
    while True:
        left = _peel(left)
        if left.isEmpty():
            break
        nodes = _nodes(left)
        colours = _spread(nodes.withColumn("value", F.col("node")), left)
        for end in ("src", "dst"):
            left = left.join(
                colours.select("repo", F.col("node").alias(end), F.col("value").alias(f"{end}_colour")), ["repo", end]
            )
        left = materialize(left.where("src_colour = dst_colour").select("repo", "src", "dst"), "cycle-colours")
        backwards = left.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
        home = F.when(F.col("value") == F.col("node"), 0).otherwise(1)
        returning = _spread(colours.withColumn("value", home), backwards).where("value = 0").select("repo", "node")
        members = materialize(
            colours.join(returning, ["repo", "node"]).select("repo", "node", F.col("value").alias("component")), "cycle-members"
        )
        # a colour whose least node is on no cycle has itself as its only member
        sizes = members.groupBy("repo", "component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        kept = members.join(sizes, ["repo", "component"], "left_semi").select("repo", "node", "component")
        found = kept if found is None else found.unionByName(kept)
        for end in ("src", "dst"):
            left = left.join(members.select("repo", F.col("node").alias(end)), ["repo", end], "left_anti")
        left = left.select("repo", "src", "dst")
    if found is None:
        return left.select("repo", F.col("src").alias("node"), F.col("src").alias("component"))
    return found


def _within_components(edges: DataFrame) -> DataFrame:
    """Edges between two nodes of one strongly connected component: those that lie on a cycle."""
    members = materialize(strong_components(edges), "cycle-components")
    for end in ("src", "dst"):
        edges = edges.join(
            members.select("repo", F.col("node").alias(end), F.col("component").alias(f"_{end}")), ["repo", end]
        )
    return edges.where("src <> dst and _src = _dst").select("repo", "src", "dst")


def elementary_cycles(edges: DataFrame, max_len: int | None = None, first: int | None = None) -> DataFrame:
    """Elementary cycles, self-loops included: ``repo, length, chain, truncated``.

    ``edges`` has ``repo, src, dst``. A chain starts at its smallest node, so each
    cycle appears once; paths grow one edge per round, within a strongly connected
    component and only through nodes greater than the start. All cycles of a length
    are found before any longer one. The loop ends when no path can grow, at
    ``max_len`` nodes if that is given, and in a repository where ``first`` cycles are
    known if that is given; cycles longer than those are not looked for.
    ``truncated`` tells whether paths of the repository were left that might have
    gone on.
    """
    graph = materialize(edges.select("repo", "src", "dst").distinct(), "cycle-edges")
    steps = materialize(_within_components(graph), "cycle-steps")
    found = [graph.where(F.col("src") == F.col("dst")).select(
        "repo", F.lit(1).alias("length"), F.array("src").alias("chain")
    )]
    closing = steps.where(F.col("dst") < F.col("src")).select(
        "repo", F.col("src").alias("last"), F.col("dst").alias("start")
    )
    growing = steps.select("repo", F.col("src").alias("last"), F.col("dst").alias("next"))
    open_paths = steps.where(F.col("dst") > F.col("src")).select(
        "repo", F.col("src").alias("start"), F.col("dst").alias("last"),
        F.array("src", "dst").alias("chain"),
    )
    stopped = steps.select("repo").limit(0)
    length = 2
    while True:
        if first is not None:
            known = reduce(DataFrame.unionByName, found).groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
            enough = known.where(F.col("_n") >= first).select("repo")
            left_open = open_paths.join(enough, "repo", "left_semi").select("repo")
            stopped = materialize(stopped.unionByName(left_open).distinct(), "cycle-stops")
            open_paths = open_paths.join(enough, "repo", "left_anti")
        if length > 2:
            open_paths = (
                open_paths.join(growing, ["repo", "last"])
                .where((F.col("next") > F.col("start")) & ~F.array_contains("chain", F.col("next")))
                .select(
                    "repo", "start", F.col("next").alias("last"),
                    F.concat("chain", F.array("next")).alias("chain"),
                )
            )
        open_paths = materialize(open_paths, f"cycle-paths-{length}")
        if open_paths.isEmpty():
            break
        if max_len is not None and length > max_len:
            stopped = stopped.unionByName(open_paths.select("repo"))
            break
        closed = open_paths.join(closing, ["repo", "start", "last"]).select("repo", F.lit(length).alias("length"), "chain")
        found.append(closed if first is None else materialize(closed, "cycles"))
        length += 1
    cycles = reduce(DataFrame.unionByName, found)
    if max_len is None and first is None:
        return cycles.withColumn("truncated", F.lit(False))
    cut = stopped.distinct().withColumn("truncated", F.lit(True))
    return cycles.join(cut, "repo", "left").fillna({"truncated": False}).select("repo", "length", "chain", "truncated")


def first_cycles(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` first cycles of each repository by length and chain: ``repo, rank, length, chain, truncated``.

    Longer cycles are not enumerated once ``k`` shorter ones are known, so a dense
    component costs its short paths only. ``truncated`` tells whether a repository
    has more cycles, or paths that were not followed to their end.
    """
    cycles = elementary_cycles(edges, first=k)
    by_length = Window.partitionBy("repo").orderBy("length", "chain")
    more = F.max("rank").over(Window.partitionBy("repo")) > k
    # one more than asked tells whether there are more, and the limit on ranks holds before the shuffle
    ranked = cycles.withColumn("rank", F.row_number().over(by_length)).where(F.col("rank") <= k + 1)
    return ranked.withColumn("truncated", F.col("truncated") | more).where(F.col("rank") <= k).select(
        "repo", "rank", "length", "chain", "truncated"
    )
