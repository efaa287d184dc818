"""Everything the other operators need to know about a file, in one row without its text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from treeline.operators.functions import add_definitions, add_spans
from treeline.operators.imports import add_imports
from treeline.operators.lexical import lex, source_rows
from treeline.operators.metrics import FILE_METRICS, add_file_metrics


def facts(
    files: DataFrame, exclude_third_party: bool = True, exclude_tests: bool = True
) -> DataFrame:
    """One row per source file: metrics, ``defined``, ``imported`` and ``spans``.

    All columns come from one pass over the text. Used once, unread columns are
    pruned; used more often, the table is small enough to be written.
    """
    source = source_rows(files, exclude_third_party, exclude_tests)
    read = add_imports(add_definitions(add_spans(add_file_metrics(lex(source)))))
    return read.select(
        "repo", "path", "ext", "language", *FILE_METRICS, "defined", "imported", "spans"
    )
