import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, node int, score string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text, source), with extra columns whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, None if t is None else len(t), "k", "r", 7, "x") for i, t, s in rows], DOCS
        )

    return make


@pytest.fixture(scope="session")
def prose():
    """Random text of made-up words."""
    def make(words, seed):
        pick = random.Random(seed)
        return " ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(2, 6))) for _ in range(words))

    return make


ODD = [
    (1, None, "a"), (2, "", "b"), (3, " \t\n", None), (None, "no id here", "c"), (4, "x", "d"),
    (5, "same text", "e"), (6, "same text", "e"), (7, "same text", "f"), (7, "same text", "f"),
    (8, "é ß 中文 \U0001F600 ▁ \x00 end", "g"), (9, "line one\r\nline two\x0b\x0c", "h"),
]


@pytest.fixture(scope="session")
def odd(documents, prose):
    """Nulls, blanks, ties, repeated rows, a long text."""
    return documents([*ODD, (10, prose(30_000, 10), "i")])
