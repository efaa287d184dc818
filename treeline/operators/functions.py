"""Function spans and cyclomatic complexity.

One scan per file (``functions/scan.py``, in Arrow batches) turns masked text into
an array of spans; text stays behind, and nothing is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from treeline.functions.rows import explode_rows
from treeline.functions.scan import functions_in

_FILE = ["repo", "path"]
_IDENT = r"[A-Za-z_$][\w$]*"
_SPANS = ArrayType(
    StructType().add("name", StringType()).add("start_line", IntegerType())
    .add("end_line", IntegerType()).add("complexity", LongType())
)


@F.pandas_udf(_SPANS)
def _spans(languages: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([
        [dict(zip(("name", "start_line", "end_line", "complexity"), span)) for span in functions_in(language, text)]
        if language and text else []
        for language, text in zip(languages, texts)
    ], dtype=object)


def add_spans(lexed: DataFrame) -> DataFrame:
    """Add ``spans``, the functions of the file in the order of their headers."""
    return lexed.withColumn("spans", _spans("language", "masked"))


def functions(facts: DataFrame) -> DataFrame:
    """Every function of every file, nested ones too, with span and complexity."""
    return explode_rows(facts, [*_FILE, "language"], "spans", "s").select(
        *_FILE, "language", F.coalesce("s.name", F.lit("unknown")).alias("name"),
        "s.start_line", "s.end_line", "s.complexity",
    )


def with_content(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Add each function's own source lines."""
    text = F.array_join(
        F.slice(F.split("content", "\n"), F.col("start_line"),
                F.col("end_line") - F.col("start_line") + 1),
        "\n",
    )
    return files.select("repo", "path", "content").join(functions, _FILE).select(
        *functions.columns, text.alias("content")
    )


def add_definitions(spanned: DataFrame) -> DataFrame:
    """Add ``defined``: the file's named functions, as in ``spans``, and its classes."""
    classes = rf"(?m)(?:^|[{{}};]|\s)class[ \t]+({_IDENT})(?=\s*(?:[({{:]|extends\b|implements\b|<))"

    def named(kind: str, names: Column) -> Column:
        return F.transform(F.array_distinct(names), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    function_names = F.filter(F.transform("spans", lambda s: s["name"]), lambda n: n.isNotNull())
    class_names = F.regexp_extract_all("masked", F.lit(classes), F.lit(1))
    return spanned.withColumn(
        "defined", F.concat(named("function", function_names), named("class", class_names))
    )


def definitions(facts: DataFrame) -> DataFrame:
    """Named functions and classes per file: ``repo, path, kind, name``."""
    return explode_rows(facts, _FILE, "defined", "d").select(*_FILE, "d.kind", "d.name")


def defined_names(facts: DataFrame) -> DataFrame:
    """Like ``definitions``, one row per name and file; a class wins over a function."""
    class_names = F.transform(
        F.filter("defined", lambda d: d["kind"] == "class"), lambda d: d["name"]
    )
    kept = F.filter(
        "defined", lambda d: (d["kind"] == "class") | ~F.array_contains("_classes", d["name"])
    )
    with_classes = facts.select(*_FILE, "defined", class_names.alias("_classes"))
    return explode_rows(with_classes, _FILE, kept, "d").select(*_FILE, "d.kind", "d.name")
