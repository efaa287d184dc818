"""Scores, buckets and display severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Highest complexity of each bucket; above the last is very_high.
COMPLEXITY_BUCKETS = (("low", 5), ("medium", 10), ("high", 20))

# Functions above this complexity are reported.
COMPLEX_ABOVE = 10


def debt_score(loc: Column, markers: Column, complexity: Column) -> Column:
    return F.round(markers * 5 + complexity * 2 + loc / F.lit(1000.0), 2)


def complexity_bucket(complexity: Column) -> Column:
    bucket = F.when(complexity <= COMPLEXITY_BUCKETS[0][1], COMPLEXITY_BUCKETS[0][0])
    for name, top in COMPLEXITY_BUCKETS[1:]:
        bucket = bucket.when(complexity <= top, name)
    return bucket.otherwise("very_high")


def complexity_severity(complexity: Column) -> Column:
    return (
        F.when(complexity.isNull(), "none").when(complexity <= 5, "green")
        .when(complexity <= 10, "yellow").when(complexity <= 20, "orange").otherwise("red")
    )


def debt_severity(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score < 50), "green").when(score < 100, "yellow")
        .when(score < 200, "orange").otherwise("red")
    )


def similarity_severity(similarity: Column) -> Column:
    s = F.coalesce(similarity, F.lit(0.0))
    return F.when(s >= 0.95, "red").when(s >= 0.90, "orange").otherwise("yellow")


def share_percent(value: Column, total: Column) -> Column:
    return F.when(total > 0, value / total * 100).otherwise(F.lit(0.0))
