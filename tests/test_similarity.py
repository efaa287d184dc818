"""Exact similarity join against all pairs, and the recall of the estimate."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from treeline.operators import minhash, similarity


def windows(text, k=5):
    import re

    t = re.sub(r"\s+", " ", text)
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def all_pairs(rows, percent, k=5):
    by_text = {}
    for scope, i, text in rows:
        if text is not None and windows(text, k):
            import re

            by_text.setdefault((scope, re.sub(r"\s+", " ", text)), []).append(i)
    found = set()
    for (s, t), (r, u) in combinations(by_text, 2):
        a, b = windows(t, k), windows(u, k)
        if s == r and 100 * len(a & b) >= percent * len(a | b):
            ids = [(min(by_text[s, t]), len(by_text[s, t])), (min(by_text[r, u]), len(by_text[r, u]))]
            (x, n), (y, m) = sorted(ids)
            found.add((s, x, y, n, m, round(len(a & b) / len(a | b), 9)))
    return found


def texts(seed, n):
    """Groups of texts that differ in some words, copies, short and odd ones."""
    pick = random.Random(seed)
    rows = [("s", -1, None), ("s", -2, ""), ("s", -3, "abcd"), ("s", -4, "abcde"), ("s", -5, "abcde  "), ("s", -6, "ab\tcde é中😀x")]
    for i in range(n):
        words = ["".join(pick.choices("abcdeé中", k=pick.randint(1, 7))) for _ in range(pick.choice([3, 20, 60]))]
        for j in range(pick.randint(1, 4)):
            changed = list(words)
            for _ in range(pick.choice([0, 1, 2, 6])):
                changed[pick.randrange(len(words))] = "".join(pick.choices("abc", k=4))
            rows.append((pick.choice("st"), 10 * i + j, pick.choice([" ", "  "]).join(changed)))
    return rows


@pytest.mark.parametrize("percent, k, most", [(85, 5, 1 << 16), (60, 3, 40), (100, 5, 0)])
def test_equals_all_pairs(spark, monkeypatch, percent, k, most):
    rows = texts(percent, 60)
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    frequent = similarity.frequent_shingles
    monkeypatch.setattr(similarity, "frequent_shingles", lambda classes, k: frequent(classes, k, most))
    got = similarity.exact_pairs(docs, percent, k).pairs.collect()
    expected = all_pairs(rows, percent, k)
    assert len(got) == len(expected) and (expected or percent == 100)
    assert {(r.scope, r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.jaccard, 9)) for r in got} == expected


def test_a_crowd_of_alike_texts_and_copies(spark):
    """A third of the rows are one text; 80 texts differ in one word of 50 each."""
    pick = random.Random(5)
    base = ["".join(pick.choices("abcdefgh", k=6)) for _ in range(50)]
    rows = [("", i, " ".join(base)) for i in range(50)]
    for i in range(80):
        changed = list(base)
        changed[i % 50] = f"word{i}"
        rows.append(("", 100 + i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    got = similarity.exact_pairs(docs).pairs.collect()
    assert {(r.scope, r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.jaccard, 9)) for r in got} == all_pairs(rows, 85)


def test_shingles_with_one_number_lose_no_pair(spark, monkeypatch):
    """The index only proposes: with 16 numbers for all shingles the pairs are the same."""
    monkeypatch.setattr(similarity, "_scattered", lambda windows: np.array([sum(w) % 16 for w in windows.tolist()], np.uint64))
    rows = texts(11, 30)
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    got = similarity.exact_pairs(docs).pairs.collect()
    expected = all_pairs(rows, 85)
    assert expected and {(r.scope, r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.jaccard, 9)) for r in got} == expected
    index = similarity.prefixes(similarity.text_classes(docs), np.zeros(0, "S20"), 85, 5)
    assert dict(index.dtypes)["key"] == "bigint"


@pytest.mark.parametrize("percent, k", [(85, 5), (40, 3), (100, 5), (1, 5)])
def test_both_proposals_lose_no_pair(spark, monkeypatch, percent, k):
    """Small tiles, so that bands meet in many cells; texts of many letters beside plain ones."""
    monkeypatch.setattr(similarity, "TILE_ROWS", 3)
    pick = random.Random(percent)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))
    rows = texts(percent + 3, 25) + [("s", 900, wide), ("s", 901, wide[:8900]), ("s", 902, "".join(pick.choices("ab ", k=30000)))]
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    expected = all_pairs(rows, percent, k)
    for propose in (similarity.sketch_candidates, similarity.prefix_candidates):
        got = similarity.exact_pairs(docs, percent, k, propose).pairs.collect()
        assert len(got) == len(expected) and (expected or percent == 100)
        assert {(r.scope, r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.jaccard, 9)) for r in got} == expected


def test_common_shingles_make_no_rows(spark, monkeypatch):
    """300 texts of 40 words share all their shingles; no row is made for a meeting, and few pairs are compared whole."""
    pick = random.Random(8)
    words = ["".join(pick.choices("abcdefgh", k=5)) for _ in range(40)]
    rows = [("", i, " ".join(pick.choices(words, k=60))) for i in range(300)]
    rows += [("", 1000 + i, rows[i][2] + " tail") for i in range(20)]
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    monkeypatch.setattr(similarity, "bucket_pairs", None)
    got = similarity.exact_pairs(docs).pairs.collect()
    expected = all_pairs(rows, 85)
    assert {(r.scope, r.id_a, r.id_b, r.copies_a, r.copies_b, round(r.jaccard, 9)) for r in got} == expected
    proposed = similarity.sketch_candidates(similarity.text_classes(docs), 85, 5).collect()
    assert 20 <= len(expected) <= len(proposed) == len(set(proposed)) < 200  # of 51040 pairs


def test_windows_and_blanks_as_before():
    """Windows of any alphabet equal those cut one by one; runs of blanks equal the plain expression."""
    import re

    from treeline.functions import text as functions

    pick = random.Random(2)
    letters = " \t\n\x1c\x85\xa0\u2003\u3000abé中😀"
    plain = re.compile(f"[{functions.SPACE}]+", re.ASCII)
    for alphabet in (letters, "ab", "".join(map(chr, range(0x3400, 0x5400)))):
        t = "".join(pick.choices(alphabet, k=9000 if len(alphabet) > 99 else 200))
        assert functions.collapsed(t) == plain.sub(" ", t)
        cut = sorted({t[i : i + 5].encode("utf-32-be") for i in range(len(t) - 4)})
        assert [w.ljust(20, b"\0") for w in similarity._windows(t, 5).tolist()] == cut


def test_links_leave_out_no_pair(spark, tmp_path):
    """Copies, texts of one signature, pairs that the estimate misses and pairs that only it proposes."""
    from checks.queries import QUERIES

    pick = random.Random(6)
    rows = []
    for i in range(30):
        base = [f"{pick.randrange(10**6):06d}" for _ in range(pick.choice([25, 300]))]
        changed = list(base)
        for _ in range(1 if len(base) == 25 else pick.choice([14, 18, 21, 22])):
            changed[pick.randrange(len(base))] = f"{pick.randrange(10**6):06d}"
        rows += [("", 100 + 10 * i, " ".join(base)), ("", 101 + 10 * i, " ".join(changed)), ("", 102 + 10 * i, " ".join(base) + "x")]
    rows += [("", 9, "  " + rows[0][2]), ("", 8, rows[0][2].replace(" ", "\n")), ("", 3000, rows[3][2]), ("", 3000, rows[3][2]), rows[3]]
    rows += [("", 5000, None), ("", 5001, "abc"), ("", 5002, "abc")]
    ids = {}
    for _, i, t in rows:
        if t is not None and windows(t):
            t = " ".join(t.split(" ")) if "\n" not in t else t.replace("\n", " ")
            t = " " + t.strip() if t.startswith(" ") else t
            ids.setdefault(t, set()).add(i)
    first = {t: min(held) for t, held in ids.items()}
    signed = {t: minhash.SlotMinima(128)(minhash.shingle_hashes(t, 5)) for t in first}
    expected, kinds = set(), {"missed": 0, "only": 0, "same": 0}
    for t, u in combinations(first, 2):
        a, b = windows(t), windows(u)
        exact, equal = 100 * len(a & b) >= 85 * len(a | b), int((signed[t] == signed[u]).sum())
        kinds["missed"] += exact and equal < 109
        kinds["only"] += not exact and equal >= 109
        kinds["same"] += equal == 128
        if exact or equal >= 109:
            expected.add((min(first[t], first[u]), max(first[t], first[u]), round(len(a & b) / len(a | b), 6)))
    expected |= {(first[t], i, 1.0) for t, held in ids.items() for i in held if i != first[t]}
    assert min(kinds.values()) > 0, kinds
    spark.createDataFrame([r[1:] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in QUERIES["exact_similarity"](spark, str(tmp_path)).collect())
    assert set(got) == expected
    assert {(a, b) for (a, b, _), n in got.items() if n == 2} == {(110, 111), (110, 112)} and max(got.values()) == 2


def test_recall_of_the_estimate(spark):
    rows = texts(7, 60)
    docs = spark.createDataFrame(rows, "scope string, id long, text string")
    exact, estimated = similarity.exact_pairs(docs), minhash.duplicates(docs)
    got = {r.scope: r for r in similarity.recall(exact.pairs, estimated.pairs, estimated.copies).collect()}
    stands = {(r.scope, r.id): r.representative for r in estimated.copies.collect()}
    known = {(r.scope, r.id_a, r.id_b) for r in estimated.pairs.collect()}
    for scope in "st":
        hits = []
        for s, a, b, *_ in all_pairs(rows, 85):
            if s == scope:
                x, y = sorted(stands.get((s, i), i) for i in (a, b))
                hits.append(x == y or (s, x, y) in known)
        assert (got[scope].exact_pairs, got[scope].found_pairs) == (len(hits), sum(hits))
    assert similarity.recall(exact.pairs.limit(0), estimated.pairs, estimated.copies).collect() == []


def test_windows_order_and_width():
    found = similarity._windows("aé中😀b\x00a", 5)
    assert len(found) == 3 and found.dtype.itemsize == 20 and len(set(similarity._scattered(found).tolist())) == 3
    assert similarity._binary(found, 5).to_pylist()[0] == found[0].ljust(20, b"\0")
    assert len(similarity._windows("abc", 5)) == 0 and similarity._scattered(np.zeros(0, "S20")).size == 0


def test_no_texts(spark):
    docs = spark.createDataFrame([], "scope string, id long, text string")
    assert similarity.exact_pairs(docs).pairs.collect() == []
    with pytest.raises(ValueError):
        similarity.exact_pairs(docs, percent=0)


def test_recall_query_makes_no_rows_of_shared_shingles(spark, tmp_path, monkeypatch):
    from checks.queries import QUERIES

    rows = [("", i, t) for i, (_, _, t) in enumerate(texts(13, 25))]
    spark.createDataFrame([r[1:] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(similarity, "bucket_pairs", None)
    got = QUERIES["minhash_recall"](spark, str(tmp_path)).collect()
    assert [r.exact_pairs for r in got] == [len(all_pairs(rows, 85))] and 0 < got[0].found_pairs <= got[0].exact_pairs
