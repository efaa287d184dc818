"""MinHash near-dedup with an LSH forest.

Texts become sets of distinct word shingles; equal sets are one node. A node's
signature has 128 minima; the forest reads it in 32 orders, rotations that start
at every fourth value. A region is a prefix of an order. Regions begin 4 values
deep, where a pair of similarity 0.8 meets in 13 of the 32 orders on average and
in none once in 10^7. A region of up to ``crowd`` nodes makes all its pairs
candidates. A larger one is led by its least node, and a node meets the ``LEADERS`` that
lead the most of its regions.

Candidates whose signatures agree in fewer values than chance allows a linked
pair (five standard errors) are dropped; the others are confirmed on full sets.
First every node checks one candidate below it, then pairs that two steps along
these links do not join are checked. Crowded regions that then still hold several
components make crowds, by the nodes they share. In a crowd of up to ``parts`` parts
(some 1,024 nodes each) all pairs of different components are compared in cells of two
parts: no more pairs than the near places below would make.

In larger crowds the regions are sorted along their orders, and each node meets the
``wide`` nodes before and behind it, those with the longest common prefixes: the
depth at which nodes meet grows with the crowd. So n copies cost some n
comparisons and not n². These pairs are compared on full sets in cells as well, of two
parts of a crowd, so a set moves once for every part it meets and not once a pair.

What is left of them are regions of more than ``wide`` nodes that still hold several
components, where a link may be no closer than many pairs without one. There all
pairs of different components are compared, in cells of two parts of a region. Cells
compare on
signatures first; the nodes that may have a link are grouped by the regions they
share, and all pairs of a group are compared on full sets.

Null texts and texts without words have no shingles and are linked with nothing;
fewer words than a shingle form one shingle. A component's id is its smallest
doc_id, and that row is kept; rows without id come after all others, by key.
Rows equal in id and text share their verdict. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from treeline.llm.components import components
from treeline.llm.store import row_key, stored
from treeline.llm.words import mixed, text_buffers, words

WORDS, SIMILARITY = 5, 80  # words of a shingle; percent
VALUES, ORDERS, CROWD, LEADERS, WIDE, PARTS = 128, 32, 8, 8, 64, 8
CELL_ROWS, CELL_SHINGLES = 1024, 1 << 20  # about what one part of a region holds
DEPTH, PLACE = 4, 48  # values that make a region, and that sort an order

_random = np.random.default_rng(80_128)
_FACTORS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BLOCK = 2048  # shingles hashed at once


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    for _, data, offsets in text_buffers(column):
        found = words(data, offsets, _IS_WORD, strong=True)
        runs = found.hashes
        for k in range(1, size):
            runs = mixed(runs[:-1] * np.uint64(3) + found.hashes[k:]) if len(runs) > 1 else runs[:0]
        for begin, end in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            if end - begin >= size:
                yield np.unique(runs[begin : end - size + 1])
            elif end > begin:
                short = found.hashes[begin : begin + 1]
                for k in range(begin + 1, end):
                    short = mixed(short * np.uint64(3) + found.hashes[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(shingles), _BLOCK):
        block = shingles[start : start + _BLOCK, None] * _FACTORS + _TERMS
        np.minimum(best, (block.min(0) >> np.uint64(32)).astype(np.uint32), out=best)
    return best


def _facts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, signatures = [], [], []
            for shingles in _sets(batch.column("text"), size):
                counts.append(len(shingles))
                nodes.append(blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                signatures.append(_signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()),
                pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary()),
            ], names=["doc_id", "key", "n_shingles", "node", "signature"])

    return run


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _prefix(values: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Names of the regions: prefix of each row's order, read cyclically."""
    name = mixed(order.astype(np.uint64) * np.uint64(256) + np.uint64(depth))
    rows, step = np.arange(len(values)), VALUES // ORDERS
    for k in range(depth):
        name = mixed(name * np.uint64(3) + values[rows, (order * step + k) % VALUES])
    return name.astype(np.int64)


def _first_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            values = _matrix(part.column("signature"), np.uint32, VALUES)
            order = np.tile(np.arange(ORDERS), part.num_rows)
            region = _prefix(np.repeat(values, ORDERS, 0), order, DEPTH)
            node = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), ORDERS)))
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(order.astype(np.int32)), pa.array(region)], names=["node", "tree", "region"]
            )


_MEMBER = "node binary, tree int, region long"


def _regions(nodes: DataFrame) -> DataFrame:
    """``region, node, tree, size, leader`` of the shared regions, of ``nodes (node, signature)``.

    A region's leader is its least node: a few nodes lead most regions of a crowd, so
    a node meets few distinct ones.
    """
    members = stored(nodes.mapInArrow(_first_regions, _MEMBER), "members")
    regions = stored(members.groupBy("region").agg(
        F.count("*").alias("size"), F.min("node").alias("leader")
    ).where("size > 1"), "regions")
    return stored(members.join(regions, "region"), "met")  # AQE splits a crowded region


def _ordered(x: Column, y: Column) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _near_pairs(met: DataFrame, crowd: int) -> DataFrame:
    """All pairs of small regions, and each node of crowded ones with some of their leaders: distinct ``a, b``, a < b.

    These are the ``LEADERS`` that lead the most of the node's regions. Regions that still hold several components then are judged by ``_crowd_pairs`` and ``exact``.
    """
    listed = met.where(F.col("size") <= crowd).groupBy("region").agg(F.collect_list("node").alias("n"))
    each = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, crowd), lambda y: _ordered(x, y))))
    # a node shares the most regions with the leaders most like it
    shared = met.where((F.col("size") > crowd) & (F.col("node") != F.col("leader"))).groupBy("node", "leader").agg(
        F.count("*").alias("regions")
    )
    best = F.sort_array(F.collect_list(F.struct("regions", "leader")), asc=False)  # one an order at most
    leaders = shared.groupBy("node").agg(F.slice(best, 1, LEADERS)["leader"].alias("leaders"))
    star = leaders.select("node", F.explode_outer("leaders").alias("leader"))
    return listed.select(F.explode_outer(each).alias("p")).select("p.a", "p.b").unionByName(
        star.select(_ordered(F.col("leader"), F.col("node")).alias("p")).select("p.a", "p.b")
    ).distinct()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place in its order: the order's number and its first values, as sortable bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column("signature"), np.uint32, VALUES)
        tree = batch.column("at").field("tree").to_numpy().astype(np.int64)
        along = (tree[:, None] * (VALUES // ORDERS) + np.arange(PLACE)) % VALUES
        chosen = np.take_along_axis(values, along, 1).astype(">u4")
        places = [bytes([t]) + row.tobytes() for t, row in zip(tree.tolist(), chosen)]
        sketch = [row.tobytes() for row in values.astype(np.uint8)]
        own = ["home", "size", "crowd", "part"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.binary()), batch.column("node"), *[batch.column("at").field(c) for c in own],
             pa.array(sketch, pa.binary())],
            names=["place", "node", *own, "sketch"],
        )


def _neighbours(wide: int, least: float):
    """Pairs within ``wide`` places that share the region, differ in component, and agree often enough."""
    head = 1 + 4 * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            old = 0 if last is None else last.num_rows
            place = _matrix(rows["place"].combine_chunks(), np.uint8, 1 + 4 * PLACE)[:, :head]
            sketch = _matrix(rows["sketch"].combine_chunks(), np.uint8, VALUES)
            home = np.array(rows["home"].to_pylist(), object)
            found = []
            for k in range(1, min(wide, rows.num_rows - 1) + 1):
                right = np.arange(max(old, k), rows.num_rows)
                same = (place[right] == place[right - k]).all(1) & (home[right] != home[right - k])
                right = right[same]
                agree = (sketch[right] == sketch[right - k]).sum(1)
                keep = agree >= least
                found.append(np.stack([right[keep] - k, right[keep]], 1))
            if found and len(pairs := np.concatenate(found)):
                node, part = rows["node"].to_pylist(), rows["part"].to_numpy()
                ends = [sorted((node[i], node[j])) for i, j in pairs.tolist()]
                parts = np.sort(part[pairs], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    rows["crowd"].combine_chunks().take(pa.array(pairs[:, 0])), pa.array(parts[:, 0]), pa.array(parts[:, 1]),
                    pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary()),
                ], names=["crowd", "x", "y", "a", "b"])
            last = rows.slice(max(0, rows.num_rows - wide)).to_batches()[0] if rows.num_rows else None

    return run


def _mixed(met: DataFrame, homes: DataFrame, crowd: int) -> DataFrame:
    """``region, tree, size, node, home, leader`` of the regions of over ``crowd`` nodes that hold several components."""
    crowded = met.where(F.col("size") > crowd).select("region", "tree", "size", "node").join(homes, "node", "left").select(
        "region", "tree", "size", "node", F.coalesce("component", "node").alias("home")
    )
    crowded = stored(crowded, "crowded")
    mixed = stored(crowded.groupBy("region").agg(
        F.min("home").alias("x"), F.max("home").alias("y"), F.min("node").alias("leader")
    ).where("x <> y").select("region", "leader"), "mixed-regions")
    return crowded.join(mixed, "region")


def _weight(shingles: Column) -> Column:
    """The share of a part that a node's set takes."""
    return F.greatest(F.lit(1 / CELL_ROWS), shingles / CELL_SHINGLES)


def _crowds(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, crowd, part, parts, weight, signature``: regions that share nodes are one crowd, cut into parts."""
    crowds = stored(components(mixed.select(F.col("node").alias("a"), F.col("leader").alias("b"))).join(
        nodes.select("node", _weight(F.col("n_shingles")).alias("weight")), "node"
    ), "crowds")
    parts = crowds.groupBy("component").agg(F.ceil(F.sum("weight")).alias("parts"))
    return stored(crowds.join(parts, "component").select(
        "node", F.xxhash64("component").alias("crowd"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        "parts", "weight",
    ).join(nodes.select("node", "signature"), "node"), "crowd-parts")


def _crowd_pairs(mixed: DataFrame, crowds: DataFrame, wide: int, least: float) -> DataFrame:
    """Distinct ``crowd, x, y, a, b`` (x and y: parts of the nodes): near places in the sorted orders of ``mixed`` regions."""
    placed = stored(mixed.join(crowds, "node").select(
        "node", F.struct("tree", "home", "size", "crowd", "part").alias("at"), "signature"
    ).mapInArrow(
        _placed, "place binary, node binary, home binary, size long, crowd long, part int, sketch binary"
    ), "places")
    # all pairs of a region of up to wide + 1 nodes are near places, if no boundary of partitions cuts it
    whole = placed.where(F.col("size") <= wide + 1).repartition(F.substring("place", 1, 1 + 4 * DEPTH))
    cut = placed.where(F.col("size") > wide + 1).repartitionByRange("place")
    pairs = [
        part.sortWithinPartitions("place", "node").select("place", "node", "home", "crowd", "part", "sketch").mapInArrow(
            _neighbours(wide, least), "crowd long, x int, y int, a binary, b binary"
        ) for part in (whole, cut)
    ]
    return pairs[0].unionByName(pairs[1]).distinct()


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """``rows (key, node, home, weight, ...)`` with ``x, y, side``, once for every cell they take part in.

    A group is cut into parts of about weight 1, those of its largest component apart.
    Cell (x, y) holds part x as side 0 and part y as side 1, or part x alone if they
    are the same. Any two nodes of a group and of different components share a cell.
    """
    counts = stored(rows.groupBy(key, "home").agg(F.sum("weight").alias("weight")), "home-weights")
    groups = counts.groupBy(key).agg(
        F.max(F.struct("weight", "home")).alias("main"), F.sum("weight").alias("weight"), F.count("*").alias("homes")
    ).where("homes > 1")
    parts = stored(groups.select(
        key, F.col("main.home").alias("main"), F.ceil("main.weight").cast("int").alias("mains"),
        F.greatest(F.ceil(F.col("weight") - F.col("main.weight")), F.lit(1)).cast("int").alias("others"),
    ), "parts")
    is_main = F.col("home") == F.col("main")
    dealt = rows.join(parts, key).withColumn("part", F.when(
        is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))
    ).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    none = F.array().cast("array<int>")
    before = F.least("part", "others")
    right = F.transform(F.when(before > 0, F.sequence(F.lit(0), before - 1)).otherwise(none), lambda x: F.struct(
        x.alias("x"), F.col("part").alias("y"), F.lit(1).alias("side")
    ))
    left = F.transform(F.when(is_main, none).otherwise(
        F.sequence("part", F.col("others") + F.col("mains") - 1)
    ), lambda y: F.struct(F.col("part").alias("x"), y.alias("y"), F.lit(0).alias("side")))
    return dealt.select(*rows.columns, F.explode_outer(F.concat(left, right)).alias("cell")).select(*rows.columns, "cell.*")


def _possible(cell: pa.Table, least: float) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides of a cell, numbers of their homes, and which pairs of different homes agree often enough."""
    side = cell["side"].to_numpy()
    home = cell["home"].combine_chunks().dictionary_encode().indices.to_numpy()
    alone = cell["x"][0] == cell["y"][0]
    at = [np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))]
    sketch = np.ascontiguousarray(_matrix(cell["sketch"], np.uint8, VALUES).T)
    same = np.zeros((len(at[0]), len(at[1])), np.uint8)
    for value in sketch:
        same += value[at[0]][:, None] == value[at[1]]
    may = (same >= least) & (home[at[0]][:, None] != home[at[1]])
    if alone:
        may = np.triu(may, 1)
    return cell.take(at[0]), cell.take(at[1]), home[at[0]], home[at[1]], may


def _promising(least: float):
    """The nodes of a cell that may have a link to another component."""
    def run(cell: pa.Table) -> pa.Table:
        left, right, _, _, may = _possible(cell, least)
        found = pa.concat_tables([left.filter(pa.array(may.any(1))), right.filter(pa.array(may.any(0)))])
        return found.select(["region", "node"])

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others, or with each other."""
    sides = [s for s in (left, right) if s is not None]
    values = [np.concatenate(s) for s in sides]
    if right is None:
        common, copies = np.unique(values[0], return_counts=True)
        common = common[copies > 1]
    else:
        common = np.intersect1d(*values)
    shared = np.zeros((len(left), len(sides[-1])), np.float32)
    places = []
    for own, sets in zip(values, sides):
        column = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
        hit = np.flatnonzero(common[column] == own) if len(common) else np.zeros(0, np.int64)
        hit = hit[np.argsort(column[hit], kind="stable")]
        places.append((column[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], len(sets)))
    for start in range(0, len(common), _BLOCK):
        width, tables = min(_BLOCK, len(common) - start), []
        for column, row, n in places:
            part = slice(*np.searchsorted(column, [start, start + width]))
            tables.append(np.zeros((n, width), np.float32))
            tables[-1][row[part], column[part] - start] = 1
        shared += tables[0] @ tables[-1].T
    return shared


def _joining(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Numbers of the pairs of homes that join what those before them did not."""
    top: dict[int, int] = {}

    def find(h: int) -> int:
        while (up := top.get(h, h)) != h:
            top[h] = top.get(up, up)
            h = up
        return h

    chosen = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        a, b = find(a), find(b)
        if a != b:
            top[a] = b
            chosen.append(k)
    return chosen


def _listed_links(similarity: int):
    """Links among the listed pairs of a cell, as many as join its nodes."""
    def run(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
        names = nodes["node"].combine_chunks()
        i, j = (pc.index_in(pairs[c], names).to_numpy().astype(np.int64) for c in "ab")
        sets = [np.asarray(s.values) for s in nodes["shingles"]]
        sizes = np.array([len(s) for s in sets], np.float64)
        (left, row), (right, column) = (np.unique(end, return_inverse=True) for end in (i, j))
        if len(i) * 32 >= len(left) * len(right):
            shared = _shared([sets[k] for k in left], [sets[k] for k in right])[row, column]
        else:
            shared = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(i.tolist(), j.tolist())])
        is_link = shared * 100.0 >= (sizes[i] + sizes[j] - shared) * similarity
        i, j = i[is_link], j[is_link]
        chosen = _joining(i, j)
        return pa.table({"a": names.take(pa.array(i[chosen])), "b": names.take(pa.array(j[chosen]))})

    return run


def _linked(least: float, similarity: int):
    """Links of a cell, as many as join its components."""
    def run(cell: pa.Table) -> pa.Table:
        left, right, home_x, home_y, may = _possible(cell, least)
        alone = cell["x"][0] == cell["y"][0]
        rows, columns = (np.flatnonzero(may.any(1) | may.any(0)),) * 2 if alone else (
            np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        )
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(rows):
            sets = [[np.asarray(s.values) for s in t["shingles"].take(pa.array(k))] for t, k in ((left, rows), (right, columns))]
            shared = _shared(sets[0], None if alone else sets[1])
            sizes = [np.array([len(s) for s in own], np.float64) for own in sets]
            union = sizes[0][:, None] + sizes[1] - shared
            i, j = np.nonzero((shared * 100.0 >= union * similarity) & may[np.ix_(rows, columns)])
            i, j = rows[i], columns[j]
            chosen = _joining(home_x[i], home_y[j])
            i, j = i[chosen], j[chosen]
        return pa.table({
            "a": left["node"].take(pa.array(i)).combine_chunks(), "b": right["node"].take(pa.array(j)).combine_chunks(),
        })

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            left, right = (_matrix(batch.column(c), np.uint8, VALUES) for c in ("sketch_a", "sketch_b"))
            same = pa.array((left == right).sum(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), same], names=["a", "b", "same"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of every value of the signature."""
    for batch in batches:
        if batch.num_rows:
            low = _matrix(batch.column("signature"), np.uint32, VALUES).astype(np.uint8)
            rows = pa.array([row.tobytes() for row in low], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), rows], names=["node", "sketch"])


def _beside(pairs: DataFrame, side: str, values: DataFrame, name: str) -> DataFrame:
    """``pairs`` with the value of one side's node; AQE splits a node of many pairs."""
    own = values.select(F.col("node").alias(side), F.col(name).alias(f"{name}_{side}"))
    return pairs.join(own, side)


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    both = _beside(_beside(pairs.select("a", "b"), "b", sets, "shingles"), "a", sets, "shingles")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return both.where(shared * 100 >= union * similarity).select("a", "b")


def _listed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [s.view(np.int64) for s in _sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    return run


def near_duplicates(
    documents: DataFrame, size: int = WORDS, similarity: int = SIMILARITY, crowd: int = CROWD, wide: int = WIDE,
    parts: int = PARTS,
) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` of every row of ``documents (doc_id, text)``.

    ``key`` names the row (``row_key``).
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"
    )
    facts = stored(texts.mapInArrow(
        _facts(size), "doc_id long, key binary, n_shingles long, node binary, signature binary"
    ), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")  # a row without id comes last
    nodes = stored(facts.where("node is not null").groupBy("node").agg(
        F.min(first).alias("first"), F.any_value("signature").alias("signature"), F.any_value("n_shingles").alias("n_shingles")
    ), "nodes")
    signatures = nodes.select("node", "signature")
    sketches = signatures.mapInArrow(_sketches, "node binary, sketch binary")
    p = similarity / 100
    least = VALUES * p - 5 * (VALUES * p * (1 - p)) ** 0.5

    def likely(pairs: DataFrame) -> DataFrame:
        both = _beside(_beside(pairs, "b", sketches, "sketch"), "a", sketches, "sketch")
        return stored(both.mapInArrow(_agreement, "a binary, b binary, same int").where(F.col("same") >= least), "likely")

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sources = nodes.join(wanted, "node", "left_semi").select("first.key", "node")
        listed = texts.select("key", "text").join(sources, "key").select("node", "text").mapInArrow(
            _listed(size), "node binary, shingles array<long>"
        )
        return stored(listed.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")

    def apart(pairs: DataFrame, homes: DataFrame) -> DataFrame:
        own = [homes.select(F.col("node").alias(k), F.col("component").alias(f"home_{k}")) for k in "ab"]
        joined = pairs.join(own[0], "a", "left").join(own[1], "b", "left")
        return joined.where(F.coalesce("home_a", "a") != F.coalesce("home_b", "b")).select("a", "b")

    def by_cell(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs (crowd, x, y, a, b)``; a set goes to the cells where its node has a pair."""
        cell = ["crowd", "x", "y"]
        ends = [pairs.select(*cell, F.col(c).alias("node")).distinct() for c in "ab"]
        taking = stored(ends[0].unionByName(ends[1]).distinct(), "cell-nodes")
        sets = sets_of(taking.select(F.col("node").alias("a"), F.col("node").alias("b")))
        return stored(pairs.groupBy(*cell).cogroup(taking.join(sets, "node").groupBy(*cell)).applyInArrow(
            _listed_links(similarity), "a binary, b binary"
        ), "crowd-links")

    def at_home(rows: DataFrame, homes: DataFrame) -> DataFrame:
        return rows.join(homes, "node", "left").withColumn("home", F.coalesce("component", "node")).drop("component")

    def exact(rows: DataFrame, homes: DataFrame) -> DataFrame | None:
        """Links between components among the nodes of each region of ``rows (region, node, home, weight)``."""
        rows = stored(rows.select("region", "node", "home", "weight").join(sketches, "node"), "mixed-crowds")
        if rows.isEmpty():
            return None
        flagged = stored(_cells(rows, "region").groupBy("region", "x", "y").applyInArrow(
            _promising(least), "region long, node binary"
        ).distinct(), "promising")
        if flagged.isEmpty():
            return None
        leaders = flagged.groupBy("region").agg(F.min("node").alias("b"))
        groups = stored(components(flagged.join(leaders, "region").select(F.col("node").alias("a"), "b")), "groups")
        sets = sets_of(groups.select(F.col("node").alias("a"), F.col("node").alias("b")))
        weight = _weight(F.size("shingles"))
        rows = at_home(groups.withColumnRenamed("component", "group"), homes).join(sketches, "node").join(
            sets, "node"
        ).withColumn("weight", weight)
        return stored(_cells(stored(rows, "promising-sets"), "group").groupBy("group", "x", "y").applyInArrow(
            _linked(least, similarity), "a binary, b binary"
        ), "exact-links")

    met = _regions(signatures)
    close = likely(stored(_near_pairs(met, crowd), "near-pairs"))
    sets = sets_of(close)
    # of a node's probable links the one with the least node, which makes shallow trees; else the best
    sure = F.col("same") >= VALUES * p
    choice = F.struct(~sure, F.when(sure, 0).otherwise(-F.col("same")), "a")
    best = close.groupBy("b").agg(F.min(choice).alias("best")).select("best.a", "b")
    links = stored(_confirmed(best, sets, similarity), "links")
    # pairs that two steps along these links already join need no check
    step = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    further = step.select(F.col("node").alias("component"), F.col("component").alias("end"))
    near = stored(step.join(further, "component", "left").select(
        "node", F.coalesce("end", "component").alias("component")
    ), "near-homes")
    links = stored(links.unionByName(_confirmed(apart(close, near), sets, similarity)), "links")
    homes = stored(components(links), "components")
    mixed = stored(_mixed(met, homes, crowd), "mixed")
    if not mixed.isEmpty():
        crowds = _crowds(mixed, nodes)
        few, many = crowds.where(F.col("parts") <= parts), crowds.where(F.col("parts") > parts).select("node")
        more = exact(at_home(few.withColumnRenamed("crowd", "region"), homes), homes)
        if more is not None:
            links = links.unionByName(more)
        if not many.isEmpty():
            links = links.unionByName(by_cell(stored(
                _crowd_pairs(mixed, crowds.where(F.col("parts") > parts), wide, least), "crowd-pairs"
            )))
            homes = stored(components(links), "components")
            left = _mixed(met.join(many, "node", "left_semi"), homes, wide + 1)
            more = exact(left.withColumn("weight", F.lit(1 / CELL_ROWS)), homes)
            if more is not None:
                links = links.unionByName(more)
        homes = stored(components(links), "components")
    own = nodes.select("node", "first")
    component = stored(homes.join(own, "node").groupBy("component").agg(F.min("first").alias("least")), "component-ids")
    named = stored(homes.join(component, "component").select("node", "least"), "homes")
    found = stored(
        own.join(named, "node", "left").select("node", F.coalesce("least", "first").alias("least")), "node-components"
    )
    slim = facts.drop("signature")
    with_words = slim.where("node is not null").join(found, "node").withColumns(
        {"component_id": F.col("least.doc_id"), "kept": F.col("key") == F.col("least.key")}
    )
    without = slim.where("node is null").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True)})
    columns = ["doc_id", "key", "n_shingles", "component_id", "kept"]
    return with_words.select(columns).unionByName(without.select(columns))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of every component; rows equal in id and text count as one."""
    dropped = near_duplicates(documents, **options).where("not kept").select("key").distinct()
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        row_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    return rows.join(dropped, "key", "left_anti").select("row.*")
