import zlib

import numpy as np
import pytest

from treeline.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def case(spark, documents, prose):
    rows = []
    for k in range(400):
        words = prose(40, k).split()
        if k % 3 == 0:
            words[k % 40] = ("idiocy", "scumbag")[k % 2]
        rows.append((k, " ".join(words), "s"))
    labels = [(k, 0, int(k % 3 == 0), "x") for k in range(400)] + [(0, 1, 0, "x"), (None, 1, 1, "x"), (1, 1, None, "x")]
    return documents(rows), spark.createDataFrame(labels, LABELS)


def test_held_out_rows_are_told_apart(case):
    docs, labels = case
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((found[k] >= 0.5) == (k % 3 == 0) for k in held)
    assert right / len(held) > 0.95
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in found if found[k] < 0.5}


def test_scores_are_the_sums_of_the_weights(case, odd):
    weights = np.zeros(1 << toxicity.BITS)
    weights[::7] = 0.25
    model = toxicity.Model(weights, -1.0)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count()
    for text, expected in ((None, -1.0), ("", -1.0)):
        assert any(r.score == pytest.approx(1 / (1 + np.exp(-expected))) for r in out)
    rows, features = toxicity._present(["Same text", "same TEXT"])
    assert sorted(features[rows == 0]) == sorted(features[rows == 1])
    long = "abcde " * 200_000  # read in pieces
    assert set(toxicity._present([long])[1]) == set(toxicity._present(["abcde " * 20])[1])


def test_without_classes_or_rows(spark, documents, odd):
    none = spark.createDataFrame([], LABELS)
    model = toxicity.train(odd, none)
    assert {r.score < 1e-6 for r in toxicity.score(odd, model).collect()} == {True}
    assert toxicity.score(documents([]), model).collect() == []
    assert toxicity.clean(odd, model).count() == odd.count()


def test_texts_too_short_for_any_gram(spark, documents):
    model = toxicity.Model(np.full(1 << toxicity.BITS, 0.25), -1.0)
    alone = [r.score for r in toxicity.score(documents([(1, "x", "s")]), model).collect()]
    assert alone == [pytest.approx(1 / (1 + np.exp(1)))]
    assert len(toxicity._present(["ab" * (toxicity._PIECE // 2) + "a"])[1]) == 6  # the last piece has one code point
    docs = documents([(k, ("x", "ok")[k % 2], "s") for k in range(20)])
    labels = spark.createDataFrame([(k, 0, k % 2, "x") for k in range(20)], LABELS)
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 20 and len({r.score for r in found}) == 1
