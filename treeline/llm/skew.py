"""Salts for keys that hold more than a small share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.llm.store import stored


def hot_keys(rows: DataFrame, key: str, shares: int = 4096) -> DataFrame:
    """``key, salts``: the keys with over 1/``shares`` of all rows, so at most ``shares`` of them, to broadcast."""
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("copies")), f"{key}-counts")
    share = max(1.0, (counts.agg(F.sum("copies")).first()[0] or 0) / shares)
    hot = counts.where(F.col("copies") > share).select(key, F.ceil(F.col("copies") / share).cast("long").alias("salts"))
    return F.broadcast(hot)


def hot_among(counts: DataFrame, key: str | list[str], total: int, shares: int = 4096) -> DataFrame:
    """As ``hot_keys``, from ``counts (key, copies)`` at hand; keys that are missing there hold few of the ``total`` rows."""
    keys = [key] if isinstance(key, str) else key
    share = max(1.0, total / shares)
    hot = counts.where(F.col("copies") > share).select(*keys, F.ceil(F.col("copies") / share).cast("long").alias("salts"))
    return F.broadcast(stored(hot, f"{keys[0]}-hot"))


def salted(rows: DataFrame, key: str | list[str], hot: DataFrame, *by: str) -> DataFrame:
    """``rows`` with a ``salt``, dealt by the hash of ``by`` where the key is hot, else 0."""
    salt = F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1)))
    return rows.join(hot, key, "left").withColumn("salt", salt).drop("salts")


def for_every_salt(unique: DataFrame, key: str | list[str], hot: DataFrame) -> DataFrame:
    """``unique``, which has one row per key, once for every salt of the key."""
    salts = F.explode_outer(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))
    return unique.join(hot, key, "left").withColumn("salt", salts).drop("salts")
