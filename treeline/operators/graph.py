"""Dependency graph as ``nodes`` and ``edges`` tables, and measures over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeline.functions import paths


@dataclass(frozen=True)
class Graph:
    """``nodes(repo,id,type,language,name,file,module)``,
    ``edges(repo,src,dst,dst_type,relationship,module)`` and the file paths among
    the nodes, ``files(repo,path)``."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def without_externals(self) -> Graph:
        """Drop external nodes and the edges that reach them."""
        return Graph(
            self.files,
            self.nodes.where(F.col("type") != "external"),
            self.edges.where(F.col("dst_type") != "external"),
        )


def build(files: DataFrame, defined: DataFrame, resolved: DataFrame) -> Graph:
    """Graph of files, their functions and classes, and imports.

    ``files`` has ``repo, path, ext``, ``defined`` one row per file and name.
    Several imports of one target leave one edge, with the last one's module.
    """
    text = F.lit(None).cast("string")
    defined_id = paths.node_id(F.col("path"), F.col("name"))
    external = paths.external_id(F.col("module"))
    nodes = (
        files.select(
            "repo", F.col("path").alias("id"), F.lit("file").alias("type"),
            F.col("ext").alias("language"), text.alias("name"), text.alias("file"),
            text.alias("module"),
        )
        .unionByName(defined.select(
            "repo", defined_id.alias("id"), F.col("kind").alias("type"),
            text.alias("language"), "name", F.col("path").alias("file"), text.alias("module"),
        ))
        .unionByName(
            resolved.where(F.col("target").isNull()).select("repo", "module").distinct().select(
                "repo", external.alias("id"), F.lit("external").alias("type"),
                text.alias("language"), text.alias("name"), text.alias("file"), "module",
            )
        )
    )
    defines = defined.select(
        "repo", F.col("path").alias("src"), defined_id.alias("dst"),
        F.col("kind").alias("dst_type"), F.lit("defines").alias("relationship"),
        text.alias("module"),
    )
    imported = (
        resolved.select(
            "repo", F.col("path").alias("src"), F.coalesce("target", external).alias("dst"),
            F.when(F.col("target").isNull(), "external").otherwise("file").alias("dst_type"),
            "module", "import_no",
        )
        .groupBy("repo", "src", "dst", "dst_type")
        .agg(F.max_by("module", "import_no").alias("module"))
        .select("repo", "src", "dst", "dst_type", F.lit("imports").alias("relationship"), "module")
    )
    return Graph(files.select("repo", "path"), nodes, defines.unionByName(imported))


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes of each type."""
    return nodes.groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """In- and out-degree of every file; out-degree counts ``defines`` edges too.

    Ends of edges and the files themselves meet in one aggregation, so files
    without edges stay at 0 and a popular file shrinks before the shuffle.
    """
    def rows(df: DataFrame, file: str, out: Column, imports: Column, into: Column) -> DataFrame:
        return df.select(
            "repo", F.col(file).alias("file"), out.alias("o"), imports.alias("i"), into.alias("n")
        )

    zero, one = F.lit(0), F.lit(1)
    imports = F.when(F.col("relationship") == "imports", 1).otherwise(0)
    ends = (
        rows(graph.edges, "src", one, imports, zero)
        .unionByName(rows(graph.edges.where(F.col("dst_type") == "file"), "dst", zero, zero, one))
        .unionByName(rows(graph.files, "path", zero, zero, zero))
    )
    return ends.groupBy("repo", "file").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("import_out_degree"),
        F.sum("n").alias("in_degree"),
    )


def top_files(degrees: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The ``k`` files of each repository with the largest degree, ties by path.

    The rank limit is applied before the shuffle as well, so at most ``k`` rows
    per task and repository move.
    """
    order = Window.partitionBy("repo").orderBy(F.desc(by), "file")
    ranked = degrees.select("repo", "file", by, F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def average_degree(edges: Column, nodes: Column) -> Column:
    return F.when(nodes > 0, F.round(edges * 2 / nodes, 2)).otherwise(F.lit(0.0))


def density(edges: Column, nodes: Column) -> Column:
    return F.when(nodes > 1, F.round(edges / (nodes * (nodes - 1)), 4)).otherwise(F.lit(0.0))


def graph_stats(graph: Graph) -> DataFrame:
    """Node counts, edge count, average degree and density of each repository."""
    kind = F.col("type")
    nodes = graph.nodes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(kind == "file").alias("total_files"),
        F.count_if(kind == "function").alias("total_functions"),
        F.count_if(kind == "class").alias("total_classes"),
        F.count_if(kind == "external").alias("total_external_dependencies"),
    )
    edges = graph.edges.groupBy("repo").agg(F.count(F.lit(1)).alias("total_edges"))
    n, e = F.col("total_nodes"), F.col("total_edges")
    return nodes.join(edges, "repo", "left").fillna({"total_edges": 0}).select(
        "*",
        average_degree(e, n).alias("average_connections_per_node"),
        density(e, n).alias("graph_density"),
    )


def neighbours(edges: DataFrame, file: str | None = None) -> DataFrame:
    """One hop around a file, or around every file: one row per neighbour.

    ``direction`` is ``dependency`` for successors and ``dependent`` for
    predecessors. Rows are not gathered per file, as a popular file may be
    imported by a large part of the corpus.
    """
    away = edges.select(
        "repo", F.col("src").alias("file"), F.lit("dependency").alias("direction"),
        F.col("dst").alias("neighbour"), F.col("dst_type").alias("type"), "relationship",
    )
    back = edges.where(F.col("dst_type") == "file").select(
        "repo", F.col("dst").alias("file"), F.lit("dependent").alias("direction"),
        F.col("src").alias("neighbour"), F.lit("file").alias("type"), "relationship",
    )
    both = away.unionByName(back)
    return both if file is None else both.where(F.col("file") == file)


def file_records(facts: DataFrame, file: str | None = None) -> DataFrame:
    """``repo, file, imports, functions, classes`` of a file, or of every file.

    A file without edges has a row, a path that is no file has none; its
    neighbours are the rows of ``neighbours``.
    """
    def names(kind: str) -> Column:
        return F.transform(F.filter("defined", lambda d: d["kind"] == kind), lambda d: d["name"])

    records = facts.select(
        "repo", F.col("path").alias("file"), F.col("imported").alias("imports"),
        names("function").alias("functions"), names("class").alias("classes"),
    )
    return records if file is None else records.where(F.col("file") == file)


def folder_keys(nodes: DataFrame) -> DataFrame:
    """Folder each node is shown under."""
    return nodes.select(
        "repo", "id", "type",
        paths.folder_key(F.col("type"), F.col("id"), F.col("file")).alias("folder"),
    )


def node_link_rows(graph: Graph) -> DataFrame:
    """Node-link JSON, one object per row: ``section`` is ``nodes`` or ``links``."""
    nodes = graph.nodes.select(
        "repo", F.lit("nodes").alias("section"),
        F.to_json(F.struct("id", "type", "language", "name", "file", "module")).alias("json"),
    )
    links = graph.edges.select(
        "repo", F.lit("links").alias("section"),
        F.to_json(F.struct(
            F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", "module"
        )).alias("json"),
    )
    return nodes.unionByName(links)
