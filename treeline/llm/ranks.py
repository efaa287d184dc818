"""Dense places of rows in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treeline.llm.store import stored


def numbered(rows: DataFrame, name: str, place: str, *order: Column) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in ``order``, written as a table.

    Ranges of the order are sorted on their own; what lies before a range is
    summed from one count per range, so nothing is gathered but these counts.
    ``order`` must tell all rows apart, else ties fall as they come.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return written.withColumn("_part", part).join(F.broadcast(before), "_part").select(
        *rows.columns, (F.col("_before") + within).alias(place)
    )
