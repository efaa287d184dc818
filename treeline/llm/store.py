"""Input tables and intermediate tables of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeline.session import configure, new_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, *partitioned: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the table.

    The table cuts the lineage: a lost executor costs a read of its files, not
    a second run of what made them.
    """
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partitioned).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes naming a row by id and text; only rows equal in both share them.

    Ids may be null or repeated, so an id alone does not name a row.
    """
    parts = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(parts.cast("binary")))
