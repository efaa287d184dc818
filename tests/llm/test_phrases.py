import random
import re
from collections import Counter

import numpy as np
import pytest

from treeline.llm import phrases


def brute_force(rows, max_words, least, top):
    """Best phrases of (text, lang) rows by counting every phrase in a dictionary."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    found = []
    for lang, seen in counts.items():
        candidates = {p: a for p, a in seen.items() if 2 <= len(p) and a >= least}
        within = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        ranked = []
        for p, a in candidates.items():
            score, k = min((1_000_000 * a * a // (seen[p[:k]] * seen[p[k:]]), k) for k in range(1, len(p)))
            if not 100 * within[p] >= 50 * a:
                ranked.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def mined(spark, rows, **options):
    """Rows get columns named like the operator's own."""
    docs = spark.createDataFrame([(t, g, 1, "s", 2) for t, g in rows], "text string, lang string, n int, seq string, chunk int")
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


ROWS = [
    (None, "en"), ("", "en"), (" \t\n", None), ("New  York\tCity. new york CITY, new york", "en"), ("x", "de"),
    ("a a a a a", "en"), ("a a a a a", "en"), ("Ä ä Ä ä;  b　c Ä ä", None), ("...!?\r\n,", "fr"),
]


def prose(seed, words, alphabet="abcde"):
    pick = random.Random(seed)
    return "".join(pick.choice(alphabet) + pick.choice("abc") + pick.choice([" ", " ", " ", "  ", ", ", "\n"]) for _ in range(words))


@pytest.mark.parametrize("max_words, least, top", [(3, 2, 2000), (4, 3, 7), (2, 1, 2000)])
def test_equals_brute_force(spark, max_words, least, top):
    rows = ROWS + [(prose(i, 60), ["en", "de", None][i % 3]) for i in range(30)]
    assert mined(spark, rows, max_words=max_words, least=least, top=top) == brute_force(rows, max_words, least, top)


def test_phrases_across_cut_chunks_and_many_merges(spark, monkeypatch):
    """A text of many chunks, a hot language, and merges of two partial counts at a time."""
    monkeypatch.setattr(phrases, "_FAN", 2)
    monkeypatch.setattr(phrases, "_SHARED", 7)
    monkeypatch.setattr(phrases, "_BLOCK", 9)
    rows = ROWS + [(prose(1, 3000), "en")] + [(prose(2, 200), "en")] * 20 + [(prose(3, 100), "de")]
    assert mined(spark, rows, chunk_words=40) == brute_force(rows, 3, 10, 2000)


def test_sparse_tiles(spark):
    """More words than the dense tiles hold, each text twice."""
    pick = random.Random(5)
    names = [f"w{i}" for i in range(12_000)]
    rows = [(" ".join(pick.choices(names, k=2000)), "en") for _ in range(20)] * 2
    assert mined(spark, rows, least=2, top=100_000) == brute_force(rows, 3, 2, 100_000)


def test_addresses_are_reversible():
    pick = np.random.default_rng(1)
    left, right = pick.integers(0, 1 << 24, 5000), pick.integers(0, 1 << 24, 5000)
    left[:2000] >>= 12
    right[1000:3000] >>= 14
    tiles, cells = phrases._address(left, right, 3)
    back = [phrases._ids(int(t), cells[i : i + 1]) for i, t in enumerate(tiles)]
    assert [(int(a[0]), int(b[0])) for a, b in back] == list(zip(left.tolist(), right.tolist()))
    sparse = tiles[tiles > phrases._SPARSE]
    assert len(sparse) < 5000 and len(set(sparse >> 31)) < 64 + 16 * 8


def test_products_beyond_64_bits(spark):
    """The cut of a table whose counts are as large as a corpus of 100 TB has."""
    from pyspark.sql import functions as F

    n, l, r = 3_000_000_000_000, 9_000_000_000_001, 4_000_000_000_003
    row = spark.createDataFrame([(n, ["a", "b"], [l, n], [r, n])], "n long, words array<string>, prefixes array<long>, suffixes array<long>")
    assert row.select(F.expr(phrases._CUT).alias("cut")).first().cut.score == 10**6 * n * n // (l * r)


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []
