"""Pairs of rows that share a bucket, without a hot bucket in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.session import materialize


def shared_buckets(rows: DataFrame, key: list[str], id_col: str, cell_rows: int) -> DataFrame:
    """``rows`` of the buckets with more than one, each with its part ``_part`` of ``_last + 1``.

    Rows often come out of an explode over a small table. Its size on disk tells
    nothing about theirs, so neither side may be broadcast by estimate.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parts = F.ceil(F.col("_n") / cell_rows).cast("int")
    return rows.hint("merge").join(sizes, key).select(
        *rows.columns, (parts - 1).alias("_last"),
        F.pmod(F.xxhash64(id_col), parts).cast("int").alias("_part"),
    )


def bucket_pairs(rows: DataFrame, key: list[str], id_col: str, cell_rows: int = 1000) -> DataFrame:
    """Join ``rows`` with itself on ``key``: columns ``a_*`` and ``b_*``, each pair once.

    Buckets of one row, usually most, are dropped first, and what is left is
    written for both sides to read. A bucket of n rows is cut into
    ceil(n / cell_rows) parts and each pair of parts is a join cell of its own,
    so no task holds more than two parts however large the bucket is, and no
    pair is lost.
    """
    placed = materialize(shared_buckets(rows, key, id_col, cell_rows), "shared-buckets")

    def side(prefix: str, own: str, other: str, span) -> DataFrame:
        return placed.select(
            *key,
            *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in key],
            F.col("_part").alias(own), F.explode(span).alias(other),
        )

    left = side("a", "_row", "_column", F.sequence("_part", "_last"))
    right = side("b", "_column", "_row", F.sequence(F.lit(0), F.col("_part")))
    in_order = F.col(f"a_{id_col}") < F.col(f"b_{id_col}")
    return (
        left.hint("merge").join(right, [*key, "_row", "_column"])
        .where((F.col("_row") < F.col("_column")) | in_order)
        .drop("_row", "_column")
    )
