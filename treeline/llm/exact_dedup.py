"""Exact dedup by skew-safe combining, in DataFrame expressions only.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]``
is deleted. Three stages compare whole normalised texts, each keyed by digest:

1. every task combines its own rows (the map side of the aggregation),
2. rows of one (digest, salt) meet and combine,
3. the salt winners of one digest combine.

Only a digest with more than 1/``shares`` of all rows gets salts, as many as cut
it into groups of that size. There are at most ``shares`` such digests, which
bounds both the broadcast list of them and the winners of stage 3.

Empty input gives no rows. A null text counts as empty, and empty texts are
equal. A null id sorts behind every id, so a row that has one wins only among
rows without. Rows repeated in id and length share the verdict of their id.
Two texts under one digest stay two groups: such digests are combined once more
by digest and whole text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.store import stored

_SPACE = r"[\x20\x09-\x0D]+"
# code points first, then the smallest id: chars * 10^20 + (2^63 - id); 0 stands for a null id
_LENGTH_UNIT, _TOP = "100000000000000000000", "9223372036854775808"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _rank(doc_id: Column, text: Column) -> Column:
    chars = F.char_length(F.coalesce(text, F.lit(""))).cast("decimal(10,0)")
    low = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return (chars * F.lit(_LENGTH_UNIT).cast("decimal(21,0)") + low).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    low = rank % F.lit(_LENGTH_UNIT).cast("decimal(38,0)")
    return F.when(low != 0, (F.lit(_TOP).cast("decimal(38,0)") - low).cast("long"))


def _salt(copies: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "rank"), F.coalesce(copies, F.lit(1)))


def exact_duplicates(
    documents: DataFrame, digest: Callable[[Column], Column] = sha256, shares: int = 4096
) -> DataFrame:
    """One row per row of ``documents (doc_id, text)``: ``doc_id, digest, keep_id, group_size, kept``."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("content"),
        _rank(F.col("doc_id").cast("long"), F.col("text")).alias("rank"),
    ).withColumn("digest", digest(F.col("content")))
    facts = stored(rows.drop("content"), "digests")
    share = max(1.0, facts.count() / shares)
    hot = facts.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") > share).select(
        "digest", F.ceil(F.col("copies") / share).cast("long").alias("salts")
    )
    hot = F.broadcast(stored(hot, "hot-digests"))  # at most `shares` rows

    def salted(df: DataFrame) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("salt", _salt(F.col("salts")))

    # stages 1 and 2; the content goes on only where a third stage needs it
    combined = salted(rows).groupBy("digest", "salt", F.col("salts").isNotNull().alias("is_hot"), "content").agg(
        F.max("rank").alias("best"), F.count("*").alias("size")
    )
    combined = stored(combined.withColumn("content", F.when(F.col("is_hot"), F.col("content"))), "salt-winners")
    # stage 3
    parts = combined.where("is_hot")
    winners = parts.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    slim = ["digest", "salt", "best", "size"]
    classes = combined.where("not is_hot").select(slim).unionByName(
        parts.select("digest", "content", "salt").join(winners, ["digest", "content"]).select(slim)
    )
    mixed = combined.groupBy("digest", "salt").count().where("count > 1").select("digest").distinct()
    if mixed.isEmpty():
        found = salted(facts).join(classes, ["digest", "salt"])
    else:
        mixed = stored(mixed, "mixed-digests")
        own = rows.join(mixed, "digest", "left_semi")
        by_text = own.groupBy("digest", "content").agg(F.max("rank").alias("best"), F.count("*").alias("size"))
        columns = ["doc_id", "digest", "rank", "best", "size"]
        found = salted(facts).join(mixed, "digest", "left_anti").join(classes, ["digest", "salt"]).select(
            columns
        ).unionByName(own.join(by_text, ["digest", "content"]).select(columns))
    return found.select(
        "doc_id", "digest", _id_of(F.col("best")).alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
    )

