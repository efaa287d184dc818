"""From raw documents to token ids, in five stages written to Parquet one by one.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. Each is written as Parquet and read
again as the next one's ``docs``.

- toxicity: documents the classifier rejects go,
- lines: boilerplate lines that many sites carry go, but for their first occurrence,
- near_duplicates: one document of each group stays (five-word shingles, 0.8),
- decontamination: documents that hold a benchmark passage go,
- tokens: SentencePiece ids beside the columns of ``documents``; columns there that are
  called ``ids`` or ``n_tokens`` give way to those of the stage.

Rows are judged by their own text, with or without an id; in a group of near
copies a row with the smallest id stays, or one without where no row has an id.
Rows equal in id and text count as one document and stay or go together. Null and
empty texts pass all stages. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from treeline.llm.store import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_boilerplate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs)
    own = {"n_tokens", "ids"}
    return encoded.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own],
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("lines", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

# a trained classifier and a tokenizer are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of ``documents``, after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
