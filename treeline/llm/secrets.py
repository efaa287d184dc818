"""Secret scan: candidate strings, and a random forest that drops the false ones.

In DataFrame expressions and Spark's own forest only. A candidate is a run of at
least ``SHORTEST`` characters of base64, hex or identifier alphabets, or a value of
any length and of any non-blank characters that is assigned to a credential word,
follows ``Bearer``, ``Basic`` or a credential option, or is the password of
``user:password@host``. An unquoted value goes without closing punctuation and ends
where ``&``, ``,`` or ``;`` begins another assignment. Its features:

- length, distinct characters, shares of digits, capitals, hex digits and symbols,
- transitions: how often neighbouring characters change their class, and the mean
  log probability of letter pairs, counted over all words of the corpus,
- dictionary coverage: the share that frequent words of the corpus cover,
- path: its depth and whether it names tests, examples or documentation,
- neighbouring words: credential words just before (or a user's name, with a host
  behind) or near, an assignment, quotes,
  and whether the words beside it are dictionary words.

The dictionary (``words`` entries) and the letter pairs (37 x 37) have fixed
sizes; the counts behind them cover all texts. The forest learns from at most
``train_rows`` labelled findings per class, those with the smallest hash.

Null and empty texts and documents without candidates give no rows; a null source
has an empty path. Equal candidates of a document are findings of their own,
numbered from 0. Repeated rows repeat their findings. Without labelled findings of
both classes nothing can be ruled out: every score is 1. Other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.store import stored

SHORTEST, CONTEXT, WORDS, TRAIN_ROWS, TREES, DEPTH = 16, 48, 200, 5_000, 20, 8
_CREDENTIAL = r"(?:key|token|secret|passw|pwd|passphrase|auth|credential|bearer|api)"
_LONG = r"[A-Za-z0-9][A-Za-z0-9+/_\-]{%d,}+={0,2}" % (SHORTEST - 1)
_OPTION = rf"--?[A-Za-z\-]{{0,16}}(?i:{_CREDENTIAL})[A-Za-z\-]{{0,16}}"
_NAMED = (  # the short tests come first, since the long one is tried at every place
    r"(?<=[=:>\"'`\s])(?=[^\s\"'`=>])(?:"
    rf"(?<=[=:>]\s{{0,2}}[\"'`]?)(?<=(?i:{_CREDENTIAL})[\w\-]{{0,16}}[\"'\]]{{0,2}}\s{{0,2}}[=:]{{1,3}}>?\s{{0,2}}[\"'`]?)"
    rf"|(?<=\b(?i:bearer|basic)\s[\"'`]?)|(?<=(?:^|\s){_OPTION}\s[\"'`]?))"
)
_NEXT = r"(?!\s{0,2}[\"']?[A-Za-z_][\w\-]{0,40}[\"']?\s{0,2}[=:])"
_VALUE = (
    r"(?:(?<=\")[^\s\"]+|(?<=')[^\s']+|(?<=`)[^\s`]+"
    rf"|(?<![\"'`])[^\s&,;]*(?:[&,;]{_NEXT}[^\s&,;]*){{0,64}}(?<![,;.)\]}}>\"'`\s=:]))"
)
_PASSWORD = r"[^\s\"'<>]{1,1024}(?=@[A-Za-z0-9\[])"
_CANDIDATE = "|".join([
    rf"{_LONG}(?=[^\sA-Za-z0-9]*(?:\s|$))", rf"(?<=:)(?<=://[^\s/:@]{{1,64}}:){_PASSWORD}", _NAMED + _VALUE,
    rf"(?<=[A-Za-z0-9._%+\-]:)(?!//){_PASSWORD}", _LONG,
])
_ASIDE = r"(?i)(?:test|example|sample|mock|fixture|dummy|doc)"
_SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"  # any other character is the 37th
_CLASSES = "a" * 26 + "A" * 26 + "0" * 10
_ALL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def findings(documents: DataFrame) -> DataFrame:
    """``doc_id, source, nth, candidate, before, after`` of ``documents (doc_id, text, source)``."""
    text = F.coalesce("text", F.lit(""))
    gaps = F.split(text, _CANDIDATE)
    found = F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0))
    context = F.transform(gaps, lambda g: F.struct(
        F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")
    ))
    cut = documents.select("doc_id", "source", found.alias("found"), context.alias("context"))
    each = F.transform("found", lambda c, i: F.struct(
        i.alias("nth"), c.alias("candidate"), F.col("context")[i]["tail"].alias("before"),
        F.col("context")[i + 1]["head"].alias("after"),
    ))
    rows = cut.where(F.size("found") > 0).select("doc_id", "source", F.explode_outer(each).alias("one"))
    return rows.select("doc_id", "source", "one.*")


def _lowered_words(documents: DataFrame) -> DataFrame:
    words = F.split(F.lower("text"), r"[^a-z0-9]+")
    return documents.where("text is not null").select(F.explode_outer(words).alias("word")).where("word <> ''")


def language(documents: DataFrame, words: int = WORDS) -> tuple[list[str], list[float]]:
    """The most frequent words of 3 to 12 letters, and probabilities of symbol pairs, row by row."""
    counts = stored(_lowered_words(documents).groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    frequent = counts.where(F.col("word").rlike("^[a-z]{3,12}$")).orderBy(F.desc("n"), "word").limit(words)
    at = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = counts.where(F.length("word").between(2, 64)).select(
        "n", F.explode_outer(F.transform(at, lambda i: F.substring("word", i, F.lit(2)))).alias("pair")
    ).groupBy("pair").agg(F.sum("n").alias("n"))
    seen = {r["pair"]: r["n"] for r in pairs.collect()}  # at most 36 * 36 rows
    width = len(_SYMBOLS) + 1
    rows: list[float] = []
    for a in _SYMBOLS:
        own = [seen.get(a + b, 0) + 1.0 for b in _SYMBOLS] + [1.0]
        rows += [x / sum(own) for x in own]
    rows += [1 / width] * width
    return [r["word"] for r in frequent.collect()], rows


def _share(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, kept, "")) / F.length(text)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _symbol(text: Column, at: Column) -> Column:
    """Number of the character, 0 to 36."""
    found = F.instr(F.lit(_SYMBOLS), F.substring(text, at, F.lit(1)))  # 0 where it is none of them
    return F.pmod(found - 1, F.lit(len(_SYMBOLS) + 1))


def features(found: DataFrame, dictionary: list[str], pairs: list[float]) -> DataFrame:
    """``found`` with one column per feature; their names start with ``f_``."""
    candidate, low = F.col("candidate"), F.lower("candidate")
    before, after, path = F.col("before"), F.col("after"), F.coalesce("source", F.lit(""))
    kinds = F.regexp_replace(F.translate(candidate, _ALL, _CLASSES), r"(.)\1+", "$1")
    table = F.array(*[F.lit(p) for p in pairs])
    steps = F.greatest(F.length(candidate) - 1, F.lit(1))
    width = len(_SYMBOLS) + 1
    likely = F.aggregate(
        F.sequence(F.lit(1), steps), F.lit(0.0),
        lambda total, i: total + F.log(F.get(table, _symbol(low, i) * width + _symbol(low, i + 1))),
    ) / steps
    longest_first = "|".join(re.escape(w) for w in sorted(dictionary, key=lambda w: (-len(w), w))) or r"(?!)"
    word_before, word_after = F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1), F.regexp_extract(after, r"^[^A-Za-z]*([A-Za-z]+)", 1)
    whole_word = f"^(?:{longest_first})$"
    return found.withColumns({
        "f_length": F.length(candidate).cast("double"),
        "f_distinct": F.size(F.array_distinct(F.split(candidate, ""))).cast("double"),
        "f_digits": _share(candidate, "[^0-9]+"), "f_capitals": _share(candidate, "[^A-Z]+"),
        "f_hex": _share(candidate, "[^0-9a-f]+"), "f_symbols": _share(candidate, "[A-Za-z0-9]+"),
        "f_changes": (F.length(kinds) - 1) / steps,
        "f_likely": likely,
        "f_dictionary": 1 - F.length(F.regexp_replace(low, longest_first, "")) / F.length(candidate),
        "f_depth": (F.length(path) - F.length(F.regexp_replace(path, "/", ""))).cast("double"),
        "f_aside": _flag(path.rlike(_ASIDE)),
        "f_credential": _flag(before.rlike(rf"(?i){_CREDENTIAL}\w*[^A-Za-z0-9]{{0,5}}$") | (
            before.rlike(r"[A-Za-z0-9._%+\-]:$") & after.rlike(r"^@[A-Za-z0-9\[]")
        )),
        "f_near": _flag(before.rlike(f"(?i){_CREDENTIAL}") | after.rlike(f"(?i){_CREDENTIAL}")),
        "f_assigned": _flag(before.rlike(r"[=:]\s*[\"']?$")),
        "f_quoted": _flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        "f_word_before": _flag(F.lower(word_before).rlike(whole_word)),
        "f_word_after": _flag(F.lower(word_after).rlike(whole_word)),
    })


def _assembled(found: DataFrame) -> DataFrame:
    names = [c for c in found.columns if c.startswith("f_")]
    return VectorAssembler(inputCols=names, outputCol="vector").transform(found)


def train(
    labelled: DataFrame, dictionary: list[str], pairs: list[float], train_rows: int = TRAIN_ROWS
) -> RandomForestClassificationModel | None:
    """A forest from findings with a ``label`` (1 true, 0 false), or None without both classes."""
    order = [F.xxhash64("doc_id", "nth"), "doc_id", "nth"]
    part = [labelled.where(F.col("label") == k).orderBy(*order).limit(train_rows) for k in (0, 1)]
    sample = stored(_assembled(features(part[0].unionByName(part[1]), dictionary, pairs)).select(
        "vector", F.col("label").cast("double").alias("label")
    ), "labelled-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.7
    )
    return forest.fit(sample)


def score(
    found: DataFrame, model: RandomForestClassificationModel | None, dictionary: list[str], pairs: list[float]
) -> DataFrame:
    """``found`` with ``score``, the forest's share of votes for a true secret."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    voted = model.transform(_assembled(features(found, dictionary, pairs)))
    return voted.select(*found.columns, vector_to_array("probability")[1].alias("score"))
