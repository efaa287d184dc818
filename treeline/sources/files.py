"""Source trees read from a file system.

Spark's own file listing leaves out names that start with '_' or '.', which
would lose ``__init__.py`` and ``__tests__``. Directories are therefore listed
level by level as Spark jobs, and files are read where their paths land.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.functions import paths
from treeline.session import materialize


def _children(system: fs.FileSystem, base: str, directory: str) -> list[tuple[str, bool, str | None]]:
    """Path, whether it is a directory, and the error of a directory that cannot be listed.

    Links to directories are not followed.
    """
    at = f"{base}/{directory}" if directory else base
    try:
        found = system.get_file_info(fs.FileSelector(at))
    except OSError as failure:
        return [(directory, False, str(failure))]
    linked = isinstance(system, fs.LocalFileSystem)
    return [
        (f.path[len(base) + 1 :], f.type == fs.FileType.Directory, None) for f in found
        if not (linked and f.type == fs.FileType.Directory and os.path.islink(f.path))
    ]


def list_files(spark: SparkSession, root: str, exclude_third_party: bool = False) -> DataFrame:
    """``path, error`` of all files below ``root``, relative to it, and of directories that cannot be listed.

    With ``exclude_third_party`` vendored directories are not entered.
    """
    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for directory in batch.column("path").to_pylist():
                found = _children(system, base.rstrip("/"), directory)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.string()))],
                    ["path", "is_directory", "error"],
                )

    directories = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        listed = directories.mapInArrow(children, "path string, is_directory boolean, error string")
        if exclude_third_party:
            listed = listed.where(~paths.is_third_party(F.col("path")))
        listed = materialize(listed, "listing")
        levels.append(listed.where(~F.col("is_directory")).select("path", "error"))
        directories = listed.where("is_directory").select("path")
        if directories.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        directories = directories.repartition("path")


def read_files(listed: DataFrame, root: str, repo: str) -> DataFrame:
    """``repo, path, content, error``: text of every listed path, decoded lossily.

    A file that cannot be read keeps its row, with null content and the reason.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist()):
                content = None
                try:
                    if error is None:
                        with system.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                            content = stream.read().decode("utf-8", "ignore")
                except OSError as failure:
                    error = str(failure)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path], pa.string()), pa.array([content], pa.string()),
                        pa.array([error], pa.string()),
                    ],
                    ["path", "content", "error"],
                )

    if "error" not in listed.columns:
        listed = listed.withColumn("error", F.lit(None).cast("string"))
    return (
        listed.select("path", "error").repartition("path")
        .mapInArrow(read, "path string, content string, error string")
        .select(F.lit(repo).alias("repo"), "path", "content", "error")
    )


def scan_tree(
    spark: SparkSession, root: str, repo: str,
    extensions: tuple[str, ...] = paths.SOURCE_EXTENSIONS, exclude_third_party: bool = False,
) -> DataFrame:
    """``repo, path, content, error`` of the files below ``root`` with a given extension."""
    listed = list_files(spark, root, exclude_third_party).where(
        paths.extension(F.col("path")).isin(*extensions) | F.col("error").isNotNull()
    )
    return read_files(listed, root, repo)


def read_errors(files: DataFrame) -> DataFrame:
    """Files without content and why."""
    return files.where(F.col("content").isNull()).select(
        "repo", "path", F.coalesce("error", F.lit("no content")).alias("reason")
    )
