import re

from pyspark.sql import functions as F

from treeline.llm.exact_dedup import exact_duplicates


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for members in groups.values():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), (len(t), i) == (len(best[1]), best[0])) for i, t in members]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


ROWS = [
    (1, None, "s"), (2, " ", "s"), (3, "", "s"), (4, "a b", "s"), (5, "ab", "s"), (6, "a  b", "s"), (7, "a  b", "s"),
    (None, "q r", "s"), (8, "q r", "s"), (None, "only", "s"), (9, "\u00a0", "s"), (9, "\u00a0", "s"), (-3, "zz", "s"),
]


def test_winners_sizes_and_nulls(documents):
    assert found(exact_duplicates(documents(ROWS))) == brute(ROWS)


def test_hot_groups_are_salted_and_whole(documents):
    rows = [(i, "copy" + " " * (i % 5), "s") for i in range(400)] + [(1000 + i, f"own {i}", "s") for i in range(200)]
    assert found(exact_duplicates(documents(rows), shares=16)) == brute(rows)


def test_equal_digests_of_different_texts_stay_apart(documents):
    def weak(content):
        return F.unhex(F.lpad(F.hex(F.length(content) % 2), 2, "0"))

    rows = ROWS + [(100 + i, f"t{i % 7}", "s") for i in range(50)]
    for shares in (2, 4096):
        assert found(exact_duplicates(documents(rows), digest=weak, shares=shares)) == brute(rows)


def test_empty_table(documents):
    assert exact_duplicates(documents([])).collect() == []
