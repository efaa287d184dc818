"""Cross-site line dedup: lines that many distinct sites carry are boilerplate.

A line is what lies between newlines, compared after trimming
``[\\x20\\x09-\\x0D]``. Per line hash one HyperLogLog sketch of its sites is
merged by aggregation, in the tasks first, so a line of a third of all documents
reaches its reducer as one sketch per task; where lines are joined again, such a
line is salted. An estimate further than ``margin``
(a share, 15 standard errors at the defaults) from the threshold decides; the
lines between get an exact distinct count.

Of a boilerplate line the first occurrence (smallest doc_id, then row, then line
number) stays unless ``keep_first`` is off, so no content leaves the corpus.
Lines under ``min_chars`` code points are never judged.

Null and empty texts have no lines and stay as they are. A null source is not a
site. A null doc_id sorts last. Rows equal in id and text are one row to
``keep_first``. All columns come back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.skew import for_every_salt, salted
from treeline.llm.store import row_key, stored

SITES, MIN_CHARS, MARGIN, LOG_BUCKETS, SHARES = 5, 20, 0.25, 12, 4096
_BLANKS = " \t\n\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def judged_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``key, doc_id, site, at, line`` (16-byte hash) of every line that is long enough."""
    trimmed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(
        i.alias("at"), F.btrim(x, F.lit(_BLANKS)).alias("line")
    ))
    hashed = F.transform(
        F.filter(trimmed, lambda x: F.char_length(x["line"]) >= min_chars),
        lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(x["line"].cast("binary"))).alias("line")),
    )
    rows = documents.select(
        row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("site"), F.explode_outer(hashed).alias("one"),
    ).where("one is not null")
    return rows.select("key", "doc_id", "site", "one.at", "one.line")


def line_spread(lines: DataFrame, sites: int = SITES, margin: float = MARGIN, shares: int = SHARES) -> DataFrame:
    """``line, spread, salts`` of the lines that may be boilerplate or hold over 1/``shares`` of all lines."""
    share = F.lit(max(1.0, lines.count() / shares))
    counted = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"), F.count("*").alias("n"))
    return counted.select(
        "line", F.hll_sketch_estimate("sketch").alias("spread"),
        F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("long")).alias("salts"),
    ).where((F.col("spread") >= sites * (1 - margin)) | F.col("salts").isNotNull())


def boilerplate(lines: DataFrame, spread: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """The ``line`` hashes that at least ``sites`` distinct sites carry."""
    near = spread.where(F.col("spread").between(sites * (1 - margin), sites * (1 + margin))).select("line")
    pairs = lines.where("site is not null").groupBy("line", "site").agg(F.count("*").alias("n"))
    exact = pairs.join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return spread.where(F.col("spread") > sites * (1 + margin)).select("line").unionByName(exact.select("line"))


def removed_lines(
    documents: DataFrame, sites: int = SITES, min_chars: int = MIN_CHARS, margin: float = MARGIN,
    keep_first: bool = True,
) -> DataFrame:
    """``key, removed`` (line numbers) of the documents that lose lines."""
    lines = stored(judged_lines(documents, min_chars), "lines")
    spread = stored(line_spread(lines, sites, margin), "line-spread")
    hot = F.broadcast(spread.where("salts is not null").select("line", "salts"))  # at most SHARES rows
    found = stored(boilerplate(lines, spread, sites, margin), "boilerplate")
    hits = salted(lines.drop("site"), "line", hot, "key", "at").join(
        for_every_salt(found, "line", hot), ["line", "salt"]
    ).select("line", "salt", "key", "doc_id", "at")
    if keep_first:
        hits = stored(hits, "boilerplate-lines")
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "at")
        first = hits.groupBy("line").agg(F.min(order).alias("first"))
        hits = hits.join(for_every_salt(first, "line", hot), ["line", "salt"]).where(order != F.col("first"))
    return hits.groupBy("key").agg(F.collect_set("at").alias("removed"))


def line_dedup(documents: DataFrame, **options) -> DataFrame:
    """``row`` (the columns of ``documents (doc_id, text, source, ...)``), ``text`` (what is left of it), ``removed``."""
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    joined = rows.join(removed_lines(documents, **options), "key", "left")
    lines = _lines(F.col("row.text"))
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.transform(F.array_except(at, F.col("removed")), lambda i: lines[i])
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select("row", text.alias("text"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_boilerplate(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with the text that is left; ``n_chars``, where there is one, counts it anew."""
    fresh = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return line_dedup(documents, **options).select(*[
        (fresh[c] if c in fresh else F.col("row").getField(c)).alias(c) for c in documents.columns
    ])
