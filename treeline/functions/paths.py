"""Column functions over repository-relative paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Source extensions, in scan order.
SOURCE_EXTENSIONS = (".py", ".js", ".ts", ".java")

# Extensions admitted to the search index.
SEARCH_EXTENSIONS = (
    ".py", ".js", ".ts", ".java", ".md", ".txt", ".rst", ".yaml", ".yml", ".json",
)

# Directory names that mark third-party code.
THIRD_PARTY_NAMES = (
    "node_modules", "venv", "env", ".env", "virtualenv", "site-packages",
    "dist-packages", "__pycache__", ".venv", "vendor", "bower_components",
    "target", "build", "dist", ".gradle", "lib", "libs", "packages",
)

# Path patterns of test files, searched unanchored.
TEST_PATTERNS = (
    r"__tests__/",
    r"(^|/)tests?/",
    r"test_.*\.py$",
    r".*_test\.py$",
    r"\.spec\.(js|ts)$",
    r"\.test\.(js|ts)$",
    r"Test.*\.java$",
    r".*Test\.java$",
    r"src/test/java/",
)


def extension(path: Column) -> Column:
    """Extension with its dot; '' for none and for dot-files such as ``.py``."""
    return F.regexp_extract(path, r"[^/]*[^/.][^/]*?(\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    """Path without its extension."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(extension(path)))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` with forward slashes."""
    slashed = F.translate(path, "\\", "/")
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(
        slashed.startswith(prefix), F.substring(slashed, F.lit(len(prefix) + 1), F.length(slashed))
    ).otherwise(slashed)


def language(path: Column) -> Column:
    """Grammar a file is read with; TypeScript shares JavaScript's."""
    ext = extension(path)
    return (
        F.when(ext == ".py", "python")
        .when(ext.isin(".js", ".ts"), "javascript")
        .when(ext == ".java", "java")
    )


def is_third_party(path: Column) -> Column:
    """True when any path part, the file name included, is a vendored name."""
    names = F.array(*[F.lit(n) for n in THIRD_PARTY_NAMES])
    return F.arrays_overlap(F.split(path, "/"), names)


def is_test(path: Column) -> Column:
    """True when any test pattern is found in the path."""
    return path.rlike("|".join(f"(?:{p})" for p in TEST_PATTERNS))


def keep_path(path: Column, exclude_third_party: bool, exclude_tests: bool) -> Column:
    """Predicate of the two exclusion flags."""
    keep = F.lit(True)
    if exclude_third_party:
        keep = keep & ~is_third_party(path)
    if exclude_tests:
        keep = keep & ~is_test(path)
    return keep


def parent_dir(path: Column) -> Column:
    """Directory part, '' at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_key(node_type: Column, node_id: Column, owner: Column) -> Column:
    """Folder a graph node belongs to: '.' at the root, 'external' for externals."""
    subject = F.when(node_type == "file", node_id).otherwise(owner)
    return (
        F.when(node_type == "external", "external")
        .when(subject.contains("/"), parent_dir(subject))
        .otherwise(".")
    )


def normalize_segments(path: Column) -> Column:
    """Resolve '.' and '..' in a relative path by one fold over its segments."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            (s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.size(acc) - 1),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    return F.when(joined == "", ".").otherwise(joined)


def join_relative(directory: Column, module: Column) -> Column:
    """``module`` taken from ``directory``, normalised; null unless it starts with '.'."""
    return F.when(module.startswith("."), normalize_segments(F.concat_ws("/", directory, module)))


def module_path(module: Column) -> Column:
    """Dotted module as a path."""
    return F.replace(module, F.lit("."), F.lit("/"))


def node_id(file: Column, name: Column) -> Column:
    """Id of a function or class node."""
    return F.concat_ws("::", file, name)


def external_id(module: Column) -> Column:
    """Id of an external node."""
    return F.concat(F.lit("external::"), module)
