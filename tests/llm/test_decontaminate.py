import re

import pytest

from treeline.llm.decontaminate import contamination, decontaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, length=10):
    patterns = {}
    for item, text in items:
        w = split(text)
        if item is not None and w:
            for i in range(max(1, len(w) - length + 1)):
                patterns.setdefault(tuple(w[i : i + length]), set()).add(str(item))
    out = []
    for doc_id, text, _ in docs:
        w, hit, named = split(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(w) - n + 1):
                if found := patterns.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    named |= found
        out.append((doc_id, len(w), len(hit), tuple(sorted(named))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(prose):
    items = [
        (1, prose(30, 1)), (2, prose(30, 1)), (3, prose(10, 3)), (4, prose(4, 4)), (5, "Once"), (6, None), (7, " .,! "),
        (None, prose(12, 8)), (9, "aa " * 15), (9, "aa " * 15), (11, "ÉTÉ é中 1,2;3"), (12, prose(25, 1)),
    ]
    passage = prose(30, 1).split()
    docs = [
        (1, None, "s"), (2, "", "s"), (3, " ".join(passage), "s"), (4, "x " + ", ".join(passage[5:16]).upper() + " y", "s"),
        (5, " ".join(passage[3:12]), "s"), (6, prose(4, 4) + " and once. " + prose(10, 3), "s"), (7, "aa " * 40, "s"),
        (8, "éTÉ É中 1 2 3", "s"), (8, "été é中 1 2 3", "s"), (8, "été é中 1 2 3", "s"), (None, " ".join(passage), "s"),
        (9, prose(3000, 9) + " " + " ".join(passage) + " " + prose(3000, 10), "s"), (10, prose(50, 11), "s"),
    ] + [(100 + k, prose(600 + k, 50 + k) + " " + " ".join(passage[k : k + 12]) + " tail", "s") for k in range(12)]
    return docs, items


def test_against_brute_force_in_one_and_many_blocks(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, pattern string")
    expected = brute(docs, items)
    for block in (200_000, 7):
        found = contamination(documents(docs), bench, block_patterns=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found), key=repr) == expected
        left = decontaminated(documents(docs), bench, block_patterns=block)
        assert left.columns == documents(docs).columns
        clean = sorted(r.doc_id for r in left.collect())
        assert clean == sorted(i for i, _, n, _ in expected if not n and i is not None)


def test_empty_tables_and_odd_rows(spark, documents, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(documents([]), none).collect() == []
    assert {r.n_hit for r in contamination(odd, none).collect()} == {0}
    assert decontaminated(odd, none).count() == odd.count()
