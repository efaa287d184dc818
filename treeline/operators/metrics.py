"""Line, marker and complexity metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.functions import scores, text


FILE_METRICS = ("loc", "loc_span", "marker_comments", "marker_lines")


def add_file_metrics(lexed: DataFrame) -> DataFrame:
    """Add ``loc``, ``loc_span``, ``marker_comments`` and ``marker_lines``.

    ``loc`` counts lines that hold something besides comments and space;
    ``loc_span`` runs from the first to the last non-blank line.
    """
    trimmed = text.stripped(F.col("content"))
    return lexed.select(
        "*",
        text.line_count(F.col("code")).cast("bigint").alias("loc"),
        F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(r"\n")) + 1)
        .cast("bigint").alias("loc_span"),
        F.size(F.filter("comments", text.has_marker)).cast("bigint").alias("marker_comments"),
        text.marker_lines(F.col("content")).cast("bigint").alias("marker_lines"),
    )


def file_metrics(facts: DataFrame) -> DataFrame:
    """One row per file."""
    return facts.select("repo", "path", "ext", "language", *FILE_METRICS)


def total_metrics(per_file: DataFrame, *keys: str) -> DataFrame:
    """Totals of ``file_metrics`` by any grouping; no keys give one row."""
    return per_file.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in FILE_METRICS
        ],
    )


def function_summary(per_file: DataFrame, functions: DataFrame) -> DataFrame:
    """Function counts and complexity per repository.

    ``files_analyzed`` counts files, so repositories without any function
    keep a row with zeros.
    """
    complexity = F.col("complexity")
    bucket = scores.complexity_bucket(complexity)
    names = [name for name, _ in scores.COMPLEXITY_BUCKETS] + ["very_high"]
    counted = functions.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_functions"),
        F.max(complexity).alias("max_complexity"),
        F.min(complexity).alias("min_complexity"),
        F.round(F.avg(complexity), 2).alias("avg_complexity"),
        *[F.count_if(bucket == name).alias(name) for name in names],
    )
    files = per_file.groupBy("repo").agg(F.count(F.lit(1)).alias("files_analyzed"))
    zero = {c: 0 for c in counted.columns if c != "repo"}
    return files.join(counted, "repo", "left").fillna(zero)


def complexity_shares(summary: DataFrame) -> DataFrame:
    """The buckets of ``function_summary`` as rows, with their share in percent."""
    names = [name for name, _ in scores.COMPLEXITY_BUCKETS] + ["very_high"]
    share = F.round(scores.share_percent(F.col("n"), F.col("total_functions")), 4)
    return summary.unpivot(["repo", "total_functions"], names, "bucket", "n").select(
        "repo", "bucket", "n", share.alias("share")
    )


def complex_functions(functions: DataFrame, above: int = scores.COMPLEX_ABOVE) -> DataFrame:
    """Functions over the complexity limit."""
    return functions.where(F.col("complexity") > above)


def code_metrics(per_file: DataFrame, functions: DataFrame) -> DataFrame:
    """The nine headline figures of each repository, from one scan's tables."""
    totals = total_metrics(per_file, "repo").select("repo", "loc", "marker_comments")
    joined = totals.join(function_summary(per_file, functions), "repo")
    return joined.withColumn(
        "debt_score",
        scores.debt_score(F.col("loc"), F.col("marker_comments"), F.col("avg_complexity")),
    )
