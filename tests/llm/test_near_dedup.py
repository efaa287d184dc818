import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeline.llm import near_dedup
from treeline.llm.components import components
from treeline.llm.near_dedup import near_duplicates, without_near_duplicates


def shingles(text, size):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows, size):
    sets = [shingles(t, size) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((r[0], len(sets[i]), least.get(top(i))) for i, r in enumerate(rows)), key=repr)


def edited(text, share, seed):
    pick = random.Random(seed)
    return " ".join("new" + str(pick.randint(0, 10**6)) if pick.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def rows(prose):
    made = [(k, prose(60 + k % 40, k), "s") for k in range(60)]
    for k in range(25):  # around the threshold
        made.append((100 + k, edited(made[k][1], 0.01 * (k % 14), k), "s"))
    base = prose(200, 999)
    made += [(200 + k, edited(base, 0.03, 500 + k), "s") for k in range(60)]  # a crowd of near copies
    chain = base = prose(120, 77)
    for k in range(30):  # versions, each like the last
        chain = edited(chain, 0.02, 900 + k)
        made.append((400 - k, chain, "s"))
    made += [(500 + k, made[0][1].upper(), "s") for k in range(12)]
    made += [(600, None, "s"), (601, "", "s"), (602, " \n", "s"), (603, "one", "s"), (604, "ONE", "s"), (605, "one two", "s")]
    made += [(None, made[1][1], "s"), (None, "all alone here now", "s"), (606, "same row twice over", "s")] * 2
    return made


@pytest.mark.parametrize("size", [2, 5])
def test_components_against_brute_force(documents, rows, size):
    out = near_duplicates(documents(rows), size=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows, size)


def test_one_document_of_each_group_stays(documents, rows, odd):
    left = without_near_duplicates(documents(rows))
    assert left.columns == documents(rows).columns
    groups = {c for _, n, c in brute(rows, 5) if n and c is not None}
    kept = [r.doc_id for r in left.collect() if r.doc_id in groups]
    assert set(kept) == groups and len(kept) == len(groups) + 1  # the row that comes twice
    assert near_duplicates(documents([])).collect() == []
    assert near_duplicates(odd).count() == odd.count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1001 + k) for k in range(200)] + [(5000, 5000)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    parts = {r.component: r.n for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert parts == {0: 101, 1000: 201}


def test_hub_whose_copies_are_unlike_each_other(documents, prose):
    pick, hub = random.Random(3), prose(200, 4242).split()
    made = [(0, " ".join(hub), "s")]
    for k in range(1, 5_300):  # 0.83 like the hub, some 0.7 like each other
        copy = list(hub)
        for at in pick.sample(range(1, 199, 2), 9):
            copy[at] = f"new{k}x{at}"
        made.append((k, " ".join(copy), "s"))
    assert {r.component_id for r in near_duplicates(documents(made), size=2).collect()} == {0}


def test_words_built_to_collide(documents):
    """A Thue-Morse word of 1,024 letters and its complement have equal sums of powers modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rows = [(1, one, "s"), (2, other, "s"), (3, f"x {one} y", "s"), (4, f"x {other} y", "s"), (5, one, "s")]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows), size=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("options", [{}, {"parts": 0}])  # all pairs in cells, or near places first
def test_a_crowd_without_links_is_not_joined_pair_by_pair(documents, prose, monkeypatch, options):
    pick, base = random.Random(8), prose(200, 808).split()
    made = []
    for k in range(240):  # some 0.7 like each other, every tenth a close copy of the one before
        copy = list(base) if k % 10 != 9 else made[-1][1].split()
        for at in pick.sample(range(1, 199, 2), 9 if k % 10 != 9 else 2):
            copy[at] = f"new{k}x{at}"
        made.append((k, " ".join(copy), "s"))
    joined, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *more: joined.append(pairs.count()) or confirmed(pairs, *more))
    out = near_duplicates(documents(made), size=2, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(made, 2)
    assert len(joined) == 2  # the nodes' best candidates and those of leaders and small regions


@pytest.mark.parametrize("others", [0, 200])  # a matrix of all nodes, or the listed pairs alone
def test_listed_pairs_of_a_cell(others):
    sets = [list(range(k, k + 100)) for k in (0, 10, 20, 1000, 1010)] + [[-k, -k - 1] for k in range(1, 2 * others + 1, 2)]
    names = [k.to_bytes(2, "big") for k in range(len(sets))]
    nodes = pa.table({"node": names, "shingles": pa.array(sets, pa.list_(pa.int64()))})
    listed = [(0, 1), (1, 2), (0, 2), (3, 4), (2, 3)] + [(k, k + 1) for k in range(5, len(sets) - 1)]
    pairs = pa.table({"a": [names[a] for a, _ in listed], "b": [names[b] for _, b in listed]})
    found = near_dedup._listed_links(80)(pairs, nodes).to_pylist()
    assert [(r["a"], r["b"]) for r in found] == [(names[a], names[b]) for a, b in ((0, 1), (1, 2), (3, 4))]
