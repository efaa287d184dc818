"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(
    table: DataFrame, keep: list[str], array: str | Column, value: str, position: str | None = None
) -> DataFrame:
    """``keep`` columns with one row per array element.

    The outer form with a filter behind it gives the rows of a plain explode. A
    plain explode also gets a size filter inferred below it, and that filter
    repeats the whole expression the array comes from, regexes included.
    """
    if position is None:
        rows = table.select(*keep, F.explode_outer(array).alias(value))
    else:
        rows = table.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.where(F.col(value).isNotNull())
