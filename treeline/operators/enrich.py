"""Refactor suggestions for over-complex functions from a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from treeline.functions.text import refactor_prompt
from treeline.operators.functions import with_content
from treeline.operators.metrics import complex_functions

Scorer = Callable[[str], str]

_SCHEMA = (
    "repo string, file_path string, function_name string, complexity bigint, "
    "suggestion string, original_code string, error string"
)


def not_configured(prompt: str) -> str:
    return "Suggestions are not configured. (No model given)"


def first_complex(functions: DataFrame, limit: int = 3, by_complexity: bool = False) -> DataFrame:
    """The first ``limit`` over-complex functions of each repository, in scan order."""
    scan = ["path", "start_line"]
    order = [F.desc("complexity"), *scan] if by_complexity else scan
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return complex_functions(functions).withColumn("rank", rank).where(F.col("rank") <= limit)


def suggestions(
    functions: DataFrame, files: DataFrame, scorer: Scorer = not_configured, limit: int = 3
) -> DataFrame:
    """Ask ``scorer`` about the chosen functions; a failed call fails only its row."""
    chosen = with_content(first_complex(functions, limit), files)
    asked = chosen.withColumn("prompt", refactor_prompt(F.col("content")))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for name, prompt in zip(batch["name"], batch["prompt"]):
                try:
                    answers.append(scorer(prompt))
                    errors.append(None)
                except Exception as failure:  # any model error is a result here
                    answers.append(f"Could not generate suggestion: {failure}")
                    errors.append(f"Suggestion failed for {name}: {failure}")
            yield pd.DataFrame({
                "repo": batch["repo"], "file_path": batch["path"], "function_name": batch["name"],
                "complexity": batch["complexity"], "suggestion": answers,
                "original_code": batch["content"], "error": errors,
            })

    return asked.select("repo", "path", "name", "complexity", "content", "prompt").mapInPandas(
        ask, _SCHEMA
    )
