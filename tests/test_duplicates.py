"""MinHash, Simhash, bucket joins and leader groups against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.functions import text
from treeline.operators import minhash, simhash
from treeline.operators.buckets import bucket_pairs, shared_buckets
from treeline.session import materialize


def variants(seed, n, length=300):
    """Texts that are copies, light edits and unrelated to one another."""
    rng = random.Random(seed)
    letters = "abcdefgh "
    bases = ["".join(rng.choices(letters, k=length)) for _ in range(max(2, n // 8))]
    texts = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            text[rng.randrange(length)] = rng.choice(letters)
        texts.append((i, "".join(text)))
    return texts


def docs(spark, texts):
    return minhash.scoped(spark.createDataFrame(texts, "id long, body string"), "id", "body")


@pytest.fixture(scope="module")
def corpus(spark):
    return docs(spark, variants(1, 120))


def test_bucket_pairs_are_complete_with_a_hot_bucket(spark):
    rows = [("hot", i) for i in range(57)] + [("cold", i) for i in range(3)] + [("alone", 1)]
    given = spark.createDataFrame(rows, "key string, id long")
    got = [(r.key, *sorted((r.a_id, r.b_id))) for r in bucket_pairs(given, ["key"], "id", cell_rows=10).collect()]
    expected = {("hot", a, b) for a in range(57) for b in range(a + 1, 57)}
    expected |= {("cold", a, b) for a in range(3) for b in range(a + 1, 3)}
    assert len(got) == len(set(got)) and set(got) == expected


def test_bucket_pairs_broadcast_no_rows(spark):
    """Rows exploded from a small file are many; their estimate is that of the file."""
    few = materialize(spark.range(100).select("id", F.sequence(F.lit(1), F.lit(50)).alias("keys")), "few")
    rows = few.select("id", F.explode("keys").alias("key"))
    for built in (shared_buckets(rows, ["key"], "id", 10), bucket_pairs(rows, ["key"], "id", 10)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_pairs_equal_all_pairs(corpus, threshold):
    found = minhash.duplicates(corpus, threshold=threshold)
    signed = {r.id: np.array(r.signature) for r in minhash.signatures(corpus).collect()}
    leaders = {tuple(s.tolist()): i for i, s in sorted(signed.items(), reverse=True)}
    ids = sorted(leaders.values())
    expected = {
        (a, b): (signed[a] == signed[b]).mean() for a in ids for b in ids
        if a < b and (signed[a] == signed[b]).mean() >= threshold
    }
    got = {(r.id_a, r.id_b): r.similarity for r in found.pairs.collect()}
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k] - v) <= 0.00005 for k, v in expected.items())
    every = sum(
        (signed[a] == signed[b]).mean() >= threshold for a in signed for b in signed if a < b
    )
    assert found.stats().first().duplicate_pairs_found == every


def test_copies_name_their_representative(spark):
    found = minhash.duplicates(docs(spark, [(3, "same text here"), (1, "same text here"), (2, "same  text\nhere"), (4, "abc")]))
    assert {(r.id, r.representative) for r in found.copies.collect()} == {(2, 1), (3, 1)}
    stats = found.stats().first()
    assert (stats.files_analyzed, stats.duplicate_pairs_found) == (4, 3)


def test_signature_ignores_order_and_repeats():
    minima = minhash.SlotMinima(16)
    hashes = minhash.shingle_hashes("the quick brown fox", 5)
    assert (minima(hashes) == minima(np.concatenate([hashes[::-1], hashes]))).all()


ODD = ["", "abcd", "abcde", "ab\tcde \u2003 é中😀x" * 4, "aaaaaaa\u0085\u00a0b", "".join(map(chr, range(0x4E00, 0x4E00 + 7000))) * 2]


def test_window_sets_and_counts_equal_brute_force(spark):
    def windows(text):
        t = re.sub(r"\s+", " ", text)
        return {t[i : i + 5] for i in range(len(t) - 4)}

    for a in ODD:
        for b in ODD:
            x, y = (s.tolist() for s in text.window_sets([text.collapsed(a), text.collapsed(b)], 5))
            expected = windows(a), windows(b)
            assert (len(x), len(y)) == tuple(map(len, expected)) and len({*x} & {*y}) == len(expected[0] & expected[1])
    given = docs(spark, [*enumerate(ODD), (-1, None)])
    assert {r.id: r.shingles for r in minhash.shingle_counts(given).collect()} == {-1: None} | {i: len(windows(t)) for i, t in enumerate(ODD)}
    spaces = given.select("id", text.collapse_space(F.col("text")).alias("t")).collect()
    assert {r.id: r.t for r in spaces} == {-1: None} | {i: text.collapsed(t) for i, t in enumerate(ODD)}
    signed = {r.id for r in minhash.signatures(given).collect()}
    assert signed == {i for i, t in enumerate(ODD) if windows(t)}


def test_texts_travel_to_the_comparison_not_their_sets(spark):
    """A set of shingles is many times its text."""
    given = docs(spark, variants(5, 40))
    plan = minhash.exact_jaccard(minhash.duplicates(given).pairs, given)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_intersect" not in plan


def test_scopes_do_not_mix(spark):
    rows = [("r1", "a", "identical text body"), ("r2", "b", "identical text body")]
    given = minhash.scoped(spark.createDataFrame(rows, "repo string, p string, t string"), "p", "t", "repo")
    assert [r.duplicate_pairs_found for r in minhash.duplicates(given).stats().collect()] == [0, 0]


def test_estimate_is_close_to_jaccard(corpus):
    pairs = minhash.duplicates(corpus).pairs.select("scope", "id_a", "id_b", "similarity")
    gap = minhash.exact_jaccard(pairs, corpus).select(F.avg(F.abs(F.col("jaccard") - F.col("similarity"))))
    assert gap.first()[0] < 0.05


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = set(seeds)
    for _ in range(200):
        value = rng.choice(seeds)
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            value ^= 1 << bit
        prints.add(value)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame(
        [("", i, p, 1) for i, p in enumerate(signed)], "scope string, id long, fingerprint long, copies long")
    got = {(r.id_a, r.id_b, r.distance) for r in simhash.near_pairs(classes).collect()}
    expected = {
        (a, b, (prints[a] ^ prints[b]).bit_count()) for a in range(len(prints)) for b in range(a + 1, len(prints))
        if (prints[a] ^ prints[b]).bit_count() <= 3
    }
    assert expected and got == expected


def test_leaders_equal_the_visit_in_order(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}
    given = spark.createDataFrame([("", a, b) for a, b in edges], "scope string, id_a long, id_b long")
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(60)}
    done, expected = set(), {}
    for i in range(60):
        if i in done:
            continue
        for j in near[i] - done - {i}:
            expected[j] = i
        done |= near[i] | {i}
    assert {r.id: r.leader for r in simhash.claimed_by_leaders(given).collect()} == expected


def test_groups_follow_copies(spark):
    texts = [(1, "one text, long enough to tell"), (2, "something else entirely here"), (3, "one text, long enough to tell"), (4, " \n")]
    groups = simhash.duplicate_groups(docs(spark, texts))
    assert [(r.leader, r.id) for r in groups.members.collect()] == [(1, 3)]
    stats = groups.stats().first()
    assert (stats.files_analyzed, stats.duplicate_groups_found) == (3, 1)


def test_hot_copies_stay_one_class(spark):
    """A third of all rows with one text: no pair rows, exact count."""
    texts = variants(2, 60) + [(1000 + i, "the one hot text, over and over") for i in range(30)]
    signed = materialize(minhash.signatures(docs(spark, texts)), "hot")
    classes = minhash.signature_classes(signed)
    assert classes.where("copies >= 30").count() == 1
    assert minhash.copies(signed, classes).where("representative = 1000").count() == 29
