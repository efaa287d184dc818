import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, id int, place string, rank string, score int, block_id int"


def vectors(spark, rows):
    """Rows of (vec_id, embedding, label), with columns named like the operator's own."""
    return spark.createDataFrame([(i, v, g, 1, "p", "r", 2, 3) for i, v, g in rows], SCHEMA).repartition(4)


def brute_force(rows, is_anchor, positives, negatives, low, high):
    usable = {
        (i, g, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, g in rows
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    found = []
    for anchor, label, a in usable:
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, g) for i, g, v in usable)
        for ps, positive, _ in [(-s, i, g) for s, i, g in scored if g == label and i != anchor][:positives]:
            fits = [(i, -s) for s, i, g in scored if g != label and low * ps <= 100 * -s <= high * ps]
            found += [(anchor, positive, r, i, ps, s) for r, (i, s) in enumerate(fits[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, is_anchor="vec_id % 10 = 0", **options):
    return sorted(map(tuple, mining.hard_negatives(vectors(spark, rows), F.expr(is_anchor), **options).collect()))


def clustered(seed, n, width, labels):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels, width))
    return [(i, (centres[g := int(pick.integers(labels))] + pick.normal(size=width) * 0.7).tolist(), g) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (500, None, 1), (510, [1.0, None], 1), (520, [math.nan, 1.0], 0), (530, [math.inf, 1.0], 0),
    (540, [1.0, 1.0], None), (550, [], 1), (560, [0.5], 0), (570, [2.0, -1.0, 3.0, 0.25], 1), (570, [2.0, -1.0, 3.0, 0.25], 1),
    (580, [1.0, 1.0, 1.0, 1.0], 2), (580, [0.5, 1.0, 1.0, 1.0], 2), (580, [0.5, 1.0, 1.0, 1.0], 0), (-10, [-1.0, -1.0, 0.0, 0.0], 1),
]


def test_curve_visits_neighbours():
    """Cells in order of their keys share a side with the next one, and all keys differ."""
    for axes, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = [k.tobytes() for k in mining.curve_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        ordered = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    pick = np.random.default_rng(1)
    anchors, members = pick.integers(-300, 300, (20, 8)), pick.integers(-300, 300, (15, 40, 8))
    low, high = mining.bounds(anchors, members.min(1), members.max(1))
    scores = np.einsum("ad,bnd->abn", anchors, members)
    assert (low[:, :, None] <= scores).all() and (scores <= high[:, :, None]).all()


def test_products_are_exact_beyond_floating_point():
    a = np.array([[1 << 30, 1, -(1 << 28)]], np.int64)
    assert mining._product(a, a).item() == (1 << 60) + 1 + (1 << 56)


@pytest.mark.parametrize("sizes", [(16, 4, 2), (1024, 128, 8)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    """Odd rows, a third of all rows with one vector, few rows of a label, small and large blocks."""
    for name, size in zip(("BLOCK", "TILE", "STRIPE"), sizes):
        monkeypatch.setattr(mining, name, size)
    rows = clustered(1, 250, 6, 5) + [(1000 + i, [0.5, 1.0, -0.25, 0.0, 0.0, 1.0], i % 3 // 2) for i in range(120)] + ODD
    rows += [(2000, [0.1] * 6, 77), (2001, [0.2] * 6, 77), (2010, [0.3] * 6, 78)]
    got = mined(spark, rows)
    assert got == brute_force(rows, lambda i: i % 10 == 0, 5, 10, 30, 90) and len(got) > 500


def test_other_parameters_and_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(mining, "BLOCK", 20)
    rows = clustered(2, 150, 90, 4)
    got = mined(spark, rows, "label = 2", positives=3, negatives=4, low=-20, high=70)
    anchors = {i for i, _, g in rows if g == 2}
    assert got == brute_force(rows, anchors.__contains__, 3, 4, -20, 70) and got


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """On clustered vectors most blocks are read for few tiles."""
    monkeypatch.setattr(mining, "BLOCK", 16)
    monkeypatch.setattr(mining, "TILE", 4)
    pairs = []
    plain = mining._cells

    def watched(tiles, blocks, needs):
        cells = plain(tiles, blocks, needs)
        pairs.append((cells.count(), tiles.count() * blocks.count()))
        return cells

    monkeypatch.setattr(mining, "_cells", watched)
    pick = np.random.default_rng(3)
    rows = []
    for i in range(600):
        group = int(pick.integers(12))
        v = pick.normal(size=4) * 0.02
        v[group % 4] += 1 + group // 4
        rows.append((i, v.tolist(), group % 6))
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0, 5, 10, 30, 90)
    (positive_read, every), (negative_read, _) = pairs
    assert positive_read < every / 4 and negative_read < every / 2


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None, None), (10, None, 1)]) == []
    assert mined(spark, [(10, [1.0], 1)]) == [] and mined(spark, [(10, [], 1), (20, [], 1)]) == []
