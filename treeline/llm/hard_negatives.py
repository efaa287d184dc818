"""Hard negatives by integer inner products, read block by block.

Rows are put in order of (label, place on a Hilbert curve) and written as Parquet
blocks of ``BLOCK`` rows. A block's zone map is its least and greatest value in every
dimension and of the label. For an anchor a and a zone map the inner products lie in
[sum min(a lo, a hi), sum max(a lo, a hi)]; a block is read for an anchor only if that
interval meets what the anchor looks for: at least the score of its fifth positive
within its own block, and later the score windows of its negatives.

Anchors come in tiles of neighbours on the curve. Zone maps are laid before tiles in
pages, one page a ``stripe`` of blocks; the blocks that any anchor of a tile needs
are then joined by stripe, so each tile meets a stripe once, and a cell of tile and
block is one matrix product. Tasks keep the best of the tile at hand only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from treeline.llm.ranks import numbered
from treeline.llm.store import stored

BLOCK = 1024
TILE = 128  # anchors
STRIPE = 8  # blocks
_BITS = 4  # of each dimension on the curve
_AXES = 64  # dimensions of the curve: those that spread widest
_EXACT = 2.0**53
_NONE = -(1 << 62)
_HELD = 1 << 18


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of integers below 2^bits, as rows of bytes (Skilling, 2004)."""
    axes = cells.T.astype(np.uint32).copy()
    high = 1 << (bits - 1)
    bit = high
    while bit > 1:
        low = np.uint32(bit - 1)
        for axis in axes:
            turned = (axis & bit) > 0
            swap = np.where(turned, 0, (axes[0] ^ axis) & low).astype(np.uint32)
            axes[0] ^= np.where(turned, low, swap).astype(np.uint32)
            axis ^= swap
        bit >>= 1
    for before, axis in zip(axes, axes[1:]):
        axis ^= before
    carry = np.zeros(cells.shape[0], np.uint32)
    bit = high
    while bit > 1:
        carry ^= np.where(axes[-1] & bit, bit - 1, 0).astype(np.uint32)
        bit >>= 1
    axes ^= carry
    planes = (axes.T[:, None, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[None, :, None]) & 1
    return np.packbits(planes.reshape(len(cells), -1).astype(np.uint8), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    matrix = np.zeros((len(sizes), width), np.int64)
    matrix[np.arange(width) < sizes[:, None]] = values
    return matrix


def _small(numbers: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds the numbers, and their bytes."""
    most = max(abs(int(numbers.min())), abs(int(numbers.max()))) if numbers.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, numbers.astype(kind).tobytes()


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between each ``low`` and ``high``."""
    positive, negative = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (
        _product(positive, low) + _product(negative, high),
        _product(positive, high) + _product(negative, low),
    )


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, parts``: whole rows with floor(scale * x) for every component x."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), parts.alias("parts")
    ).distinct()


def _on_curve(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their ``place`` in order of label and Hilbert curve, and the width of their vectors."""
    spans = rows.select(F.posexplode("parts").alias("axis", "x")).groupBy("axis").agg(
        F.min("x").alias("low"), F.max("x").alias("high")
    ).sort("axis").collect()  # one row per dimension
    width = len(spans)
    low = np.array([s.low for s in spans], np.float64)
    span = np.array([s.high for s in spans], np.float64) - low
    axes = np.sort(np.argsort(-span, kind="stable")[:_AXES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("parts"), width)
            keys = np.zeros((len(matrix), 1), np.uint8)
            if len(axes):
                scaled = (matrix[:, axes] - low[axes]) / np.maximum(span[axes], 1) * ((1 << _BITS) - 1)
                keys = curve_keys(np.rint(scaled).astype(np.int64), _BITS)
            parts = pa.ListArray.from_arrays(
                pa.array(np.arange(len(matrix) + 1) * width, pa.int32()), pa.array(matrix.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), parts, pa.array([k.tobytes() for k in keys], pa.binary())],
                ["vec_id", "label", "parts", "key"],
            )

    keyed = rows.mapInArrow(run, "vec_id long, label long, parts array<long>, key binary")
    return numbered(keyed, "curve", "place", F.col("label"), F.col("key"), F.col("vec_id")).drop("key"), width


_PACKED = "id long, ids binary, labels binary, kind string, matrix binary, low binary, high binary, least long, most long"


def _packed(rows: DataFrame, size: int, width: int, name: str) -> DataFrame:
    """``rows (nth, vec_id, label, parts)`` as blocks of ``size`` by ``nth``, each sorted by ``vec_id``; with zone maps."""
    def block(number: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        kind, data = _small(matrix)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()),
            pa.array([kind]), pa.array([data], pa.binary()),
            pa.array([matrix.min(0).astype(np.int64).tobytes()], pa.binary()), pa.array([matrix.max(0).astype(np.int64).tobytes()], pa.binary()),
            pa.array([labels.min()]), pa.array([labels.max()]),
        ], ["id", "ids", "labels", "kind", "matrix", "low", "high", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            numbers = batch.column("id").to_numpy()
            columns = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("parts"), width)
            edges = np.append(np.flatnonzero(np.diff(numbers, prepend=-1)), len(numbers))
            for a, b in zip(edges[:-1], edges[1:]):
                if numbers[a] != current and held:
                    yield block(current, *(np.concatenate(x) for x in zip(*held)))
                    held = []
                current = int(numbers[a])
                held.append([c[a:b] for c in columns])
        if held:
            yield block(current, *(np.concatenate(x) for x in zip(*held)))

    numbered_blocks = rows.select((F.col("nth") / size).cast("long").alias("id"), "vec_id", "label", "parts")
    together = numbered_blocks.repartition("id").sortWithinPartitions("id", "vec_id", "label")
    return stored(together.mapInArrow(run, _PACKED), name)


def _rows(batch: pa.RecordBatch, prefix: str, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a packed block."""
    def of(name):
        return batch.column(prefix + name)[i].as_py()

    ids = np.frombuffer(of("ids"), np.int64)
    matrix = np.frombuffer(of("matrix"), of("kind")).reshape(len(ids), -1)
    return ids, np.frombuffer(of("labels"), np.int64), matrix


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of columns (group..., id, score) the ``k`` best of each group, ties to smaller ids."""
    order = np.lexsort((rows[-2], -rows[-1], *rows[:-2][::-1]))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (np.diff(rows[:-2], axis=1) != 0).any(0)
    first = np.flatnonzero(new)
    return rows[:, np.arange(rows.shape[1]) - first[np.cumsum(new) - 1] < k]


def _own_blocks(anchors: DataFrame, blocks: DataFrame, positives: int) -> DataFrame:
    """``place, vec_id, label, parts, floor`` of anchors: the score of the last of their positives in their own block."""
    grouped = anchors.groupBy((F.col("place") / BLOCK).cast("long").alias("id")).agg(
        F.collect_list(F.struct("place", "vec_id", "label", "parts")).alias("anchors")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, matrix = _rows(batch, "", i)
                here = batch.column("anchors")[i].values
                parts = here.field("parts")
                scores = _product(_matrix(parts, matrix.shape[1]), matrix)
                own, kind = here.field("vec_id").to_numpy(), here.field("label").to_numpy()
                scores[(labels != kind[:, None]) | (ids == own[:, None])] = _NONE
                floor = np.full(len(own), _NONE)
                if len(ids) >= positives:
                    floor = np.sort(scores, axis=1)[:, -positives]
                yield pa.RecordBatch.from_arrays(
                    [here.field("place"), here.field("vec_id"), here.field("label"), parts, pa.array(floor, pa.int64())],
                    ["place", "vec_id", "label", "parts", "floor"],
                )

    joined = grouped.join(blocks.select("id", "ids", "labels", "kind", "matrix"), "id")
    return stored(joined.mapInArrow(run, "place long, vec_id long, label long, parts array<long>, floor long"), "anchors")


def _cells(tiles: DataFrame, blocks: DataFrame, needs) -> DataFrame:
    """Tiles beside the blocks that they need: ``needs(tile, low, high, least, most)`` tells which of a page.

    ``tile`` is the tile's row; its zone maps are matrices with a row per block.
    """
    own = tiles.columns
    stripe = (F.col("id") / STRIPE).cast("long")
    pages = blocks.groupBy(stripe.alias("stripe")).agg(
        F.collect_list(F.struct("id", "low", "high", "least", "most")).alias("page")
    )
    stripes = (blocks.agg(F.max("id")).first()[0] or 0) // STRIPE
    every = tiles.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes).cast("long"))))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for i in range(batch.num_rows):
                page = batch.column("page")[i].as_py()
                low, high = (np.stack([np.frombuffer(z[side], np.int64) for z in page]) for side in ("low", "high"))
                least, most = (np.array([z[side] for z in page]) for side in ("least", "most"))
                needed = needs({c: batch.column(c)[i].as_py() for c in own}, low, high, least, most)
                chosen.append([z["id"] for z, need in zip(page, needed) if need])
            kept = [batch.column(c) for c in (*own, "stripe")]
            read = pa.RecordBatch.from_arrays([*kept, pa.array(chosen, pa.list_(pa.int64()))], [*own, "stripe", "chosen"])
            yield read.filter(pa.array([bool(c) for c in chosen]))

    schema = every.withColumn("chosen", F.lit(None).cast("array<long>")).schema
    chosen = every.join(pages, "stripe").select(*own, "stripe", "page").mapInArrow(choose, schema)
    sides = blocks.select(stripe.alias("stripe"), *[F.col(c).alias(f"block_{c}") for c in ("id", "ids", "labels", "kind", "matrix")])
    return chosen.join(sides, "stripe").where(F.array_contains("chosen", F.col("block_id")))


def _scored(cells: DataFrame, tile: list[str], group: list[str], k: int, pick) -> DataFrame:
    """``group..., id, score``: the best ``k`` of every group that ``pick`` finds in the cells.

    ``pick(tile, ids, labels, vectors)`` gives columns; a task adds up one tile at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0

        def best() -> np.ndarray:
            return _best(np.concatenate(held, axis=1), k)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], [*group, "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("id")[i].as_py()
                if number != current and held:
                    yield out(best())
                    held, size = [], 0
                current = number
                found = pick({c: batch.column(c)[i].as_py() for c in tile}, *_rows(batch, "block_", i))
                held.append(found)
                size += found.shape[1]
                if size >= _HELD:
                    held = [best()]
                    size = held[0].shape[1]
        if held:
            yield out(best())

    columns = [*tile, *[f"block_{c}" for c in ("ids", "labels", "kind", "matrix")]]
    schema = ", ".join(f"{c} long" for c in (*group, "id", "score"))
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    found = cells.select(*columns).mapInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchor_tiles(anchors: DataFrame, width: int, extra: list[str], name: str) -> DataFrame:
    """Packed tiles of ``anchors``, with the columns ``extra`` gathered in the order of the ids."""
    placed = stored(numbered(anchors, f"{name}-order", "nth", F.col("place")), f"{name}-numbered")
    more = placed.groupBy((F.col("nth") / TILE).cast("long").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "label", "place", *extra))).alias("rows")
    )
    tiles = _packed(placed, TILE, width, name).select("id", "ids", "labels", "kind", "matrix")
    return stored(tiles.join(more, "id").select(
        "*", *[F.col(f"rows.{c}").alias(c) for c in ("place", *extra)]
    ).drop("rows"), f"{name}-tiles")


def _tile(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["matrix"], row["kind"]).reshape(len(ids), -1), np.array(row["place"])


def _positives(tiles: DataFrame, blocks: DataFrame, positives: int) -> DataFrame:
    def needs(row, low, high, least, most):
        _, labels, matrix, _ = _tile(row)
        greatest = bounds(matrix, low, high)[1]
        shares = (least <= labels[:, None]) & (labels[:, None] <= most)
        return (shares & (greatest >= np.array(row["floor"])[:, None])).any(0)

    def pick(row, ids, labels, vectors):
        own, kind, matrix, place = _tile(row)
        scores = _product(matrix, vectors)
        scores[(labels != kind[:, None]) | (ids == own[:, None])] = _NONE
        top = np.argsort(-scores, axis=1, kind="stable")[:, :positives]
        best = np.take_along_axis(scores, top, axis=1)
        at, column = np.nonzero((best > _NONE) & (best >= np.array(row["floor"])[:, None]))
        return np.stack([place[at], own[at], ids[top[at, column]], best[at, column]])

    tile = ["id", "ids", "labels", "kind", "matrix", "place", "floor"]
    return _scored(_cells(tiles, blocks, needs), tile, ["place", "anchor_id"], positives, pick)


def _negatives(tiles: DataFrame, blocks: DataFrame, negatives: int) -> DataFrame:
    def needs(row, low, high, least, most):
        _, labels, matrix, _ = _tile(row)
        smallest, greatest = bounds(matrix, low, high)
        meets = np.zeros(smallest.shape, bool)
        for anchor, windows in enumerate(row["windows"]):
            for w in windows:
                meets[anchor] |= (greatest[anchor] >= w["low"]) & (smallest[anchor] <= w["high"])
        differs = (least != labels[:, None]) | (most != labels[:, None])
        return (meets & differs).any(0)

    def pick(row, ids, labels, vectors):
        own, kind, matrix, place = _tile(row)
        scores = _product(matrix, vectors)
        scores[labels == kind[:, None]] = _NONE
        order = np.argsort(-scores, axis=1, kind="stable")
        falling = np.take_along_axis(scores, order, axis=1)
        found = []
        for w in range(max(map(len, row["windows"]), default=0)):
            here = [x[w] if w < len(x) else None for x in row["windows"]]
            score, low, high = (np.array([x[c] if x else d for x in here]) for c, d in (("score", 0), ("low", 1), ("high", 0)))
            # the first places at or below the window's upper end
            at = (scores > high[:, None]).sum(1)[:, None] + np.arange(negatives)
            values = np.take_along_axis(falling, np.minimum(at, len(ids) - 1), axis=1)
            anchor, column = np.nonzero((at < len(ids)) & (values >= low[:, None]) & (values > _NONE) & (low <= high)[:, None])
            found.append(np.stack([
                place[anchor], score[anchor], ids[order[anchor, at[anchor, column]]], values[anchor, column],
            ]))
        return np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)

    tile = ["id", "ids", "labels", "kind", "matrix", "place", "windows"]
    return _scored(_cells(tiles, blocks, needs), tile, ["place", "positive_score"], negatives, pick)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; rows with a null in any of them or in
    a component, or with a component that is not finite, take no part. A component x
    counts as floor(scale * x), a shorter vector as one ending in zeros; scores are
    integer inner products, which must fit 64 bits. Positives of a row for which
    ``is_anchor (vec_id, label)`` holds are the ``positives`` rows of its label, but not
    of its id, with the highest scores; the negatives for one are the first
    ``negatives`` rows of other labels with scores within ``low`` to ``high`` percent
    of the positive's. Ties go to smaller ids.

    Rows equal in id, label and vector count once; rows that share an id only are rows
    of their own. Other columns are not read. No rows give no rows.
    """
    rows, width = _on_curve(stored(_usable(vectors, scale), "vectors"))
    rows = stored(rows, "places")
    blocks = _packed(rows.withColumnRenamed("place", "nth"), BLOCK, width, "blocks")
    anchors = _own_blocks(rows.where(is_anchor), blocks, positives)
    tiles = _anchor_tiles(anchors, width, ["floor"], "anchors")
    pairs = stored(_positives(tiles, blocks, positives), "positives")

    # percent by whole numbers, rounded into the window; floating point would round elsewhere
    at_most = F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100")
    at_least = F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100")
    windows = pairs.select("place", "score", at_least.alias("low"), at_most.alias("high")).where("low <= high").groupBy("place").agg(
        F.collect_set(F.struct("score", "low", "high")).alias("windows")
    )
    asking = anchors.select("place", "vec_id", "label", "parts").join(windows, "place")
    mined = _negatives(_anchor_tiles(asking, width, ["windows"], "asking"), blocks, negatives)
    chosen = pairs.select("place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(mined, ["place", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
