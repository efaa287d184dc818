"""One lexical pass per file: comments, comment-free text, masked text.

The text is cut once into comments, string literals and everything between;
the cut is lossless, so line numbers survive masking. Possessive quantifiers
keep Java's regex engine from recursing on long literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeline.functions import paths, text
from treeline.functions.rows import explode_rows

_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TEMPLATE = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
_TRIPLE_DOUBLE = r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
_TRIPLE_SINGLE = r"'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
_SLASH_COMMENT = r"//[^\n]*+|/\*.*?\*/"

_CUTS = {
    "python": "|".join(
        ["(?s)#[^\n]*+", _TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE, r"""[^#"']++""", "."]
    ),
    "javascript": "|".join(
        ["(?s)" + _SLASH_COMMENT, _DOUBLE, _SINGLE, _TEMPLATE, r"""[^/"'`]++""", "."]
    ),
    "java": "|".join(
        ["(?s)" + _SLASH_COMMENT, _TRIPLE_DOUBLE, _DOUBLE, _SINGLE, r"""[^/"']++""", "."]
    ),
}


def _by_language(make) -> Column:
    """``make(language)`` chosen by the ``language`` column."""
    chosen = None
    for name in _CUTS:
        value = make(name)
        matches = F.col("language") == name
        chosen = F.when(matches, value) if chosen is None else chosen.when(matches, value)
    return chosen


def _is_comment(cut: Column) -> Column:
    return F.when(
        F.col("language") == "python", cut.startswith("#")
    ).otherwise(cut.startswith("//") | cut.startswith("/*"))


def _is_string(cut: Column) -> Column:
    return (F.length(cut) > 1) & F.left(cut, F.lit(1)).isin('"', "'", "`")


def _newlines(cut: Column) -> Column:
    return F.when(cut.contains("\n"), F.regexp_replace(cut, r"[^\n]+", "")).otherwise("")


def source_rows(
    files: DataFrame, exclude_third_party: bool = True, exclude_tests: bool = True
) -> DataFrame:
    """Source files that survive the exclusion flags, with extension and language.

    Only ``path`` is looked at, so the filter runs below all content work.
    """
    path = F.col("path")
    return files.where(
        paths.extension(path).isin(*paths.SOURCE_EXTENSIONS)
        & paths.keep_path(path, exclude_third_party, exclude_tests)
    ).select(
        "repo", "path", paths.extension(path).alias("ext"),
        paths.language(path).alias("language"), "content",
    )


def lex(source: DataFrame) -> DataFrame:
    """Add ``comments``, ``code`` (no comments) and ``masked`` (no literals either).

    In ``masked`` a string literal is a pair of quotes; both texts keep every
    newline of the file.
    """
    cuts = source.withColumn(
        "cuts",
        _by_language(lambda name: F.regexp_extract_all("content", F.lit(_CUTS[name]), F.lit(0))),
    )
    return cuts.select(
        *source.columns,
        F.filter("cuts", _is_comment).alias("comments"),
        F.array_join(
            F.transform("cuts", lambda c: F.when(_is_comment(c), _newlines(c)).otherwise(c)), ""
        ).alias("code"),
        F.array_join(
            F.transform(
                "cuts",
                lambda c: F.when(_is_comment(c), _newlines(c))
                .when(_is_string(c), F.concat(F.lit('"'), _newlines(c), F.lit('"')))
                .otherwise(c),
            ),
            "",
        ).alias("masked"),
    )


def comments(lexed: DataFrame) -> DataFrame:
    """One row per comment, numbered in file order from 1."""
    rows = explode_rows(lexed, ["repo", "path"], "comments", "comment", "comment_no")
    return rows.withColumn("comment_no", F.col("comment_no") + 1)


def lines(lexed: DataFrame) -> DataFrame:
    """One row per line with its class: code, comment or blank."""
    both = F.arrays_zip(
        F.split("content", "\n").alias("raw"), F.split("code", "\n").alias("kept")
    )
    exploded = explode_rows(lexed, ["repo", "path"], both, "line", "line_no")
    return exploded.select(
        "repo", "path", (F.col("line_no") + 1).alias("line_no"),
        F.col("line.raw").alias("line"),
        F.when(~text.is_blank(F.col("line.kept")), "code")
        .when(~text.is_blank(F.col("line.raw")), "comment")
        .otherwise("blank").alias("line_class"),
    )
