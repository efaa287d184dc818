"""Import statements and their resolution to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeline.functions import paths
from treeline.functions.rows import explode_rows

_RECORD = "array<struct<type:string,module:string,items:array<string>>>"

_PYTHON = (
    r"(?m)^[ \t]*(?:from[ \t]+\S+[ \t]+import\b[ \t]*(?:\([^)]*\)|[^\n;\\]*+(?:\\.?\n?[^\n;\\]*+)*+)"
    r"|import[ \t]+[^\n;\\]*+(?:\\.?\n?[^\n;\\]*+)*+)"
)
_SCRIPT = (
    r"""(?m)^[ \t]*import\b\s*(?:[^'"`;]*?\bfrom\s*)?["'][^"'\n]+["']"""
    r"""|\brequire\s*\(\s*["'][^"'\n]+["']"""
)
_JAVA = r"(?m)^[ \t]*import\s+(?:static\s+)?([^;\s]+)\s*;"


def _record(kind: str, module: Column, items: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(kind).alias("type"), module.alias("module"),
        (none if items is None else items).alias("items"),
    )


def _names(listed: Column) -> Column:
    """Comma-separated names without aliases."""
    bare = F.transform(
        F.split(F.regexp_replace(listed, r"[()\\]", " "), ","),
        lambda n: F.regexp_extract(n, r"^\s*(\S+)", 1),
    )
    return F.filter(bare, lambda n: n != "")


def _python_records(statement: Column) -> Column:
    listed = F.regexp_extract(statement, r"(?s)\bimport\b(.*)$", 1)
    source = F.regexp_extract(statement, r"^\s*from\s+(\S+)", 1)
    return F.when(
        source != "", F.array(_record("from_import", source, _names(listed)))
    ).otherwise(F.transform(_names(listed), lambda n: _record("import", n)))


def _script_record(statement: Column) -> Column:
    module = F.regexp_extract(statement, r"""["']([^"'\n]+)["']$""", 1)
    clause = F.regexp_extract(statement, r"""(?s)^\s*import\s+(.*?)\s*\bfrom\s*["']""", 1)
    items = F.when(clause != "", F.array(clause)).otherwise(F.array().cast("array<string>"))
    return F.when(
        statement.rlike(r"^\s*import\b"), _record("import", module, items)
    ).otherwise(_record("require", module))


def add_imports(lexed: DataFrame) -> DataFrame:
    """Add ``imported``: an array of the file's import records in file order.

    Python and Java are read from masked text; JavaScript needs its literals.
    """
    python = F.flatten(
        F.transform(F.regexp_extract_all("masked", F.lit(_PYTHON), F.lit(0)), _python_records)
    )
    script = F.transform(F.regexp_extract_all("code", F.lit(_SCRIPT), F.lit(0)), _script_record)
    java = F.transform(
        F.regexp_extract_all("masked", F.lit(_JAVA), F.lit(1)), lambda m: _record("import", m)
    )
    records = (
        F.when(F.col("language") == "python", python)
        .when(F.col("language") == "javascript", script)
        .otherwise(java)
    )
    return lexed.withColumn("imported", records.cast(_RECORD))


def imports(facts: DataFrame) -> DataFrame:
    """One row per import: ``import_no, type, module, items``."""
    return explode_rows(facts, ["repo", "path", "language"], "imported", "i", "n").select(
        "repo", "path", "language", (F.col("n") + 1).alias("import_no"),
        "i.type", "i.module", "i.items",
    )


def relative_target(path: Column, language: Column, module: Column) -> Column:
    """Path a relative module points at, '' for an absolute one.

    A Python module with n leading dots climbs n-1 directories.
    """
    directory = paths.parent_dir(path)
    dots = F.length(F.regexp_extract(module, r"^(\.+)", 1))
    climbed = F.concat_ws(
        "/", directory, F.repeat(F.lit("../"), dots - 1),
        F.replace(F.substring(module, dots + 1, F.length(module)), F.lit("."), F.lit("/")),
    )
    target = F.when(language == "python", paths.normalize_segments(climbed)).otherwise(
        paths.join_relative(directory, module)
    )
    return F.when(module.startswith("."), target).otherwise("")


def _key(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def file_keys(files: DataFrame) -> DataFrame:
    """Every key a file can be imported by, one row per key with the first path.

    Kinds: ``full`` path, ``base`` path without extension, ``tail`` whole-segment
    suffix of the base. A leaf name shared by many files collapses in the
    map-side aggregation, so each key keeps exactly one row.
    """
    base = paths.base_name(F.col("path"))
    parts = F.split("base", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: _key("tail", F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/")),
    )
    keys = F.concat(F.array(_key("full", F.col("path")), _key("base", F.col("base"))), tails)
    return (
        explode_rows(files.select("repo", "path", base.alias("base")), ["repo", "path"], keys, "k")
        .groupBy("repo", "k.kind", "k.key")
        .agg(F.min("path").alias("target"))
    )


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``target``: the first file, in path order, an import names; null if none.

    Distinct modules are resolved first, by equality on the keys above, and the
    answer is joined back. Popular modules skew only that last join, whose other
    side has one row per module, so AQE may split the import side freely.
    """
    located = imports.withColumn(
        "relative", relative_target(F.col("path"), F.col("language"), F.col("module"))
    )
    module, relative = F.col("module"), F.col("relative")
    wanted = F.when(
        relative == "",
        F.array(_key("full", module), _key("base", module), _key("tail", paths.module_path(module))),
    ).otherwise(
        F.array(_key("full", module), _key("base", module), _key("full", relative), _key("base", relative))
    )
    resolved = (
        explode_rows(
            located.select("repo", "module", "relative").distinct(),
            ["repo", "module", "relative"], wanted, "k",
        )
        .select("repo", "module", "relative", "k.kind", "k.key")
        .join(file_keys(files), ["repo", "kind", "key"])
        .groupBy("repo", "module", "relative")
        .agg(F.min("target").alias("target"))
    )
    return located.join(resolved, ["repo", "module", "relative"], "left").select(
        *imports.columns, "target"
    )
