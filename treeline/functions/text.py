"""Column functions over text."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, functions as F

# Words that mark unfinished work in a comment.
MARKERS = ("TODO", "FIXME", "HACK")

# Fixed value: instruction text sent with a function body.
REFACTOR_PROMPT = """
You are an expert pair programmer. Your job is to analyze a piece of code and provide a safe, refactored version of it.
The user will provide a function that has been flagged for high cyclomatic complexity.

Please provide a refactored version of the code that improves readability and maintainability, and reduces complexity.

Here is the code:
---
{code_content}
---

Your suggestion:
"""

# Fixed value: longest error text kept on a job row.
MAX_ERROR_CHARS = 1000

# White space of Unicode, as the members of a character class.
SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def decode_lossy(content: Column) -> Column:
    """Bytes to text, dropping what is not valid UTF-8; valid bytes stay as they are."""
    read = content.cast("string")
    return F.when(F.is_valid_utf8(read), read).otherwise(F.replace(F.make_valid_utf8(read), F.lit("�"), F.lit("")))


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{SPACE}]")


def line_count(text: Column) -> Column:
    """Lines holding at least one non-space character."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}][^\\n]*"))


def has_marker(comment: Column) -> Column:
    """Marker word anywhere in the text, any case."""
    return F.upper(comment).rlike("|".join(MARKERS))


def marker_lines(text: Column) -> Column:
    """Lines with a marker word, case-sensitive, comment or not."""
    return F.regexp_count(text, F.lit(f"(?=[{''.join(m[0] for m in MARKERS)}])(?:{'|'.join(MARKERS)})[^\\n]*"))


# A run of white space that is not one space already.
_UNEVEN = f"[{SPACE}](?:[{SPACE}]+|(?<! ))"


def collapse_space(text: Column) -> Column:
    """Every whitespace run to one space; ends are not trimmed.

    The look-ahead turns printable ASCII away before the class is tried.
    """
    return F.regexp_replace(text, f"(?=[^!-~]){_UNEVEN}", " ")


_SPACES = re.compile(_UNEVEN, re.ASCII)


def collapsed(text: str) -> str:
    """``collapse_space`` of one string."""
    return _SPACES.sub(" ", text)


def distinct(values: np.ndarray) -> np.ndarray:
    """Values once each, sorted."""
    ordered = np.sort(values)
    return ordered[np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]])]


def window_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The distinct k-character windows of each text, as sorted values that are equal where windows are.

    Values are exact, and compare among the texts of one call only.
    """
    points = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.int64) for t in texts]
    letters = 1 + max((int(p.max()) for p in points if len(p)), default=0)
    if letters**k > 2**63:
        known = distinct(np.concatenate(points))
        points, letters = [np.searchsorted(known, p) for p in points], len(known)
    sets = []
    for p in points:
        n = max(len(p) - k + 1, 0)
        if letters**k > 2**63:  # too many letters for one number
            cut = np.lib.stride_tricks.sliding_window_view(p.astype(">u4"), k) if n else np.zeros((0, k), ">u4")
            sets.append(distinct(np.ascontiguousarray(cut).view(f"S{4 * k}").ravel()))
            continue
        values = np.zeros(n, np.int64)
        for j in range(k if n else 0):
            values = values * letters + p[j : j + n]
        sets.append(distinct(values))
    return sets


def word_chars(text: Column) -> Column:
    """Lower-cased text without anything but letters, digits and '_'."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def unquote(text: Column) -> Column:
    return F.btrim(text, F.lit("\"'"))


def stripped(text: Column) -> Column:
    """Text without whitespace of any kind at its ends.

    The look-behind lets a run of whitespace be tried once, not from each of its characters.
    """
    return F.regexp_replace(text, f"(?=[^!-~])(?:^[{SPACE}]+|(?<![{SPACE}])[{SPACE}]+$)", "")


def stripped_length(text: Column) -> Column:
    return F.length(stripped(text))


def _windows(text: Column, width: int) -> Column:
    """All overlapping windows of ``width`` characters, found in one regex pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character windows of the space-collapsed text."""
    return F.array_distinct(_windows(collapse_space(text), k))


def char_trigrams(text: Column) -> Column:
    """3-character windows with repeats; short text yields itself once."""
    t = word_chars(text)
    return F.when(F.length(t) >= 3, _windows(t, 3)).otherwise(F.array(t))


def refactor_prompt(code: Column) -> Column:
    head, tail = REFACTOR_PROMPT.split("{code_content}")
    return F.concat(F.lit(head), code, F.lit(tail))


def error_text(errors: Column) -> Column:
    """Errors joined by '; ' and cut to the stored length; null when there are none."""
    return F.when(F.size(errors) > 0, F.left(F.array_join(errors, "; "), F.lit(MAX_ERROR_CHARS)))


def _thousands(count: Column) -> Column:
    """``count / 1000`` to one decimal, rounded on the quotient's exact binary value.

    Its fraction times 2**52 is a whole number, so tenths come out of integer
    arithmetic, with halves going up.
    """
    quotient = count / F.lit(1000.0)
    whole = F.floor(quotient)
    fraction = ((quotient - whole) * F.lit(2.0**52)).cast("bigint")
    tenths = whole * 10 + F.shiftright(fraction * 10 + 2**51, 52)
    return F.concat(F.floor(tenths / 10).cast("bigint"), F.lit("."), tenths % 10, F.lit("K"))


def humanize(value: Column, is_loc: bool = False) -> Column:
    """Display text: 'N/A' for null, '1.2K' for large line counts, else grouped digits."""
    grouped = F.regexp_replace(F.format_number(value.cast("double"), 3), r"\.?0+$", "")
    shown = F.when(value.isNull(), "N/A")
    if is_loc:
        shown = shown.when(value > 1000, _thousands(value))
    return shown.otherwise(grouped)


def json_number(value: Column) -> Column:
    """Text of a double in a report; infinities become 'inf' and '-inf'."""
    return (
        F.when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(value.cast("string"))
    )
