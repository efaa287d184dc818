"""Report, vector and graph datasets, kept per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from treeline.operators.graph import Graph


def write_report(report: DataFrame, path: str) -> None:
    """JSON report rows, one folder per ``job_id``."""
    report.write.mode("append").partitionBy("job_id").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType, job_id: str) -> DataFrame:
    """Report of one job; a job without a report is an error."""
    report = spark.read.schema(schema).json(path).where(F.col("job_id") == job_id)
    if report.isEmpty():
        raise FileNotFoundError(f"no report for job {job_id} in {path}")
    return report


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``job_id, id, embedding``; the id travels with its vector, so no mapping is kept."""
    vectors.write.mode("append").partitionBy("job_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """Vectors of one job; the filter prunes to its folder."""
    return spark.read.parquet(path).where(F.col("job_id") == job_id)


def write_node_link(rows: DataFrame, path: str) -> None:
    """Node-link objects as JSON lines, ``nodes`` and ``links`` in folders of their own."""
    rows.select("repo", "section", F.col("json").alias("value")).write.mode("append").partitionBy(
        "repo", "section"
    ).text(path)


def write_gexf(graph: Graph, path: str) -> None:
    """GEXF ``node`` and ``edge`` elements, each as an XML dataset."""
    nodes = graph.nodes.select(
        F.col("id").alias("_id"), F.col("id").alias("_label"), F.col("type").alias("_type"),
    )
    edges = graph.edges.select(
        F.concat_ws("->", "src", "dst").alias("_id"), F.col("src").alias("_source"),
        F.col("dst").alias("_target"), F.col("relationship").alias("_relationship"),
    )
    for rows, root, tag in ((nodes, "nodes", "node"), (edges, "edges", "edge")):
        rows.write.option("rootTag", root).option("rowTag", tag).format("xml").save(f"{path}/{root}")
