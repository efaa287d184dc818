"""Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READ_PARTITIONS = "spark.treeline.readPartitions"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as they lie, or hashed over as many partitions as the session asks for.

    The setting is for tables of one unsplittable file, as in the small test data.
    """
    documents = read_table(spark, folder, "documents")
    wanted = spark.conf.get(READ_PARTITIONS, None)
    return documents.repartition(int(wanted), "doc_id") if wanted else documents
