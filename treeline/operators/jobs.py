"""Job records as an append-only table of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeline.functions.text import error_text

# Texts that make an error fatal for its job.
FATAL_ERRORS = (
    "Code metrics failed", "Dependency analysis failed", "Duplication analysis failed",
    "Failed to load embedding model", "FAISS index build failed", "Failed to save index/mapping",
)

_FIELDS = ("repo_url", "status", "error", "report_path", "summary")


def current_jobs(changes: DataFrame) -> DataFrame:
    """Latest state of every job.

    ``changes`` has ``job_id, seq, ts, repo_url, status, error, report_path`` and,
    if wanted, ``summary``; a null leaves a field as it was. The aggregates combine before the shuffle, so
    a job with many changes moves as one row per task.
    """
    at = F.struct("ts", "seq")

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), at)).alias(column)

    return changes.groupBy("job_id").agg(
        *[last(c) for c in _FIELDS if c in changes.columns],
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )


def append_changes(changes: DataFrame, path: str) -> None:
    """Add rows to the table of changes; nothing in it is ever rewritten."""
    changes.write.mode("append").parquet(path)


def write_batch(changes: DataFrame, path: str, batch: int) -> None:
    """Write a numbered batch of changes; writing it again replaces it.

    Batches are numbered in the order in which they come; what is in them may be of any time.
    """
    changes.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")


def _states(changes: DataFrame) -> DataFrame:
    """``job_id, first, last`` and for every field its latest value with the change it is from."""
    at = F.struct("ts", "seq")
    fields = [c for c in _FIELDS if c in changes.columns]
    return changes.groupBy("job_id").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c) for c in fields],
    )


def _merged(states: DataFrame) -> DataFrame:
    """States of the same job as one; merging a state twice changes nothing."""
    fields = [c for c in _FIELDS if c in states.columns]
    return states.groupBy("job_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.max(c).alias(c) for c in fields]
    )


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("through=")]
    done = [p for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def refresh_snapshot(spark: SparkSession, changes: str, snapshot: str) -> DataFrame:
    """Latest state of every job, as ``current_jobs`` gives it, from the last snapshot and the batches since.

    Only batches behind the last snapshot are read, by their folders; the result is
    written as the next snapshot, named by the last batch in it. A snapshot counts
    once it is complete, so a refresh that fails or runs twice does no harm, and the
    one before stays readable.
    """
    known = _versions(spark, snapshot)
    states = [spark.read.parquet(f"{snapshot}/through={known[-1]:012d}")] if known else []
    since = spark.read.parquet(changes).where(F.col("batch") > (known[-1] if known else -1))
    through = since.agg(F.max("batch")).first()[0]
    if through is not None:
        merged = _merged(reduce(DataFrame.unionByName, [*states, _states(since)]))
        path = f"{snapshot}/through={through:012d}"
        merged.write.mode("overwrite").parquet(path)
        states = [spark.read.parquet(path)]
    return states[0].select(
        "job_id", *[F.col(f"{c}.value").alias(c) for c in _FIELDS if c in states[0].columns],
        F.col("first").alias("created_at"), F.col("last").alias("updated_at"),
    )


def with_final_status(runs: DataFrame) -> DataFrame:
    """Add ``status`` and ``error`` to ``errors``: fatal errors fail the job, others are
    kept on a completed one. ``error`` is for display and cut; ``errors`` stays whole."""
    error = F.col("errors")
    fatal = F.exists(
        error, lambda e: reduce(Column.__or__, [e.contains(text) for text in FATAL_ERRORS])
    )
    return runs.select(
        *runs.columns,
        F.when(fatal, "FAILED").otherwise("COMPLETED").alias("status"),
        error_text(error).alias("error"),
    )


def status_view(jobs: DataFrame) -> DataFrame:
    """What a poller sees: the result location of completed jobs, the error of failed ones."""
    status = F.col("status")
    summary = ["summary"] if "summary" in jobs.columns else []
    return jobs.select(
        "job_id", "status", "repo_url", *summary,
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.when(status == "COMPLETED", F.concat(F.lit("/analyze/results/"), "job_id")).alias("results_url"),
        F.when(status == "FAILED", F.col("error")).alias("error"),
    )


# Fixed values below: the texts of the view.
def results_view(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """``job_id, status, error, report``: the report, or why there is none yet.

    ``reports`` has ``job_id, report``.
    """
    status = F.col("status")
    missing = (
        F.when(status.isin("PENDING", "RUNNING"), F.concat(F.lit("Job is "), status))
        .when(F.col("report_path").isNull() & (status == "FAILED"),
              F.concat(F.lit("Job failed: "), F.coalesce("error", F.lit(""))))
        .when(F.col("report_path").isNull(),
              F.concat(F.lit("Job "), status, F.lit(" but no report file path found")))
        .when(F.col("report").isNull(), "Report file not found")
    )
    return jobs.join(reports, "job_id", "left").select(
        "job_id", "status", missing.alias("error"), F.when(missing.isNull(), F.col("report")).alias("report")
    )
