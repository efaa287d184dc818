"""Exact set-similarity join: every pair of texts whose shingle sets overlap enough.

Nothing is estimated. A proposal rules out pairs that cannot reach the threshold, and
the sets of the rest are compared whole, as the characters they are. There are two:

- Sketches. Two sets that reach a Jaccard similarity t differ in (1-t)/(1+t) (|x|+|y|)
  shingles at most. A sketch has a bit for each number that shingles are dealt to, set
  where an odd count of them falls. Two sketches differ in no more bits than the sets in
  shingles, so pairs whose sketches differ in more are out, whatever the numbers are.
  Sets of like size lie in tiles, and tiles meet in cells, without an index.
- Prefixes. Such sets also share a shingle among the first |x| - ceil(t |x|) + 1 of each,
  in any order that is the same for all sets. With rare shingles first an index of prefixes
  proposes the pairs, and lengths and places rule most of them out. It pays where shingles
  are rare; those of running text are not, and its buckets then hold every pair about once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treeline.functions.text import collapse_space, distinct
from treeline.operators import minhash
from treeline.operators.buckets import bucket_pairs
from treeline.operators.minhash import with_overlap
from treeline.session import materialize

FREQUENT = 1 << 16  # shingles that are ordered by how many texts hold them; rarer ones come before
BANDS = 8  # bands of sizes from one power of two to the next
TILE_BITS = 1 << 23  # of the sketches in a tile
TILE_ROWS = 1 << 13
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(text: str, k: int) -> np.ndarray:
    """The distinct k-character windows of a text, each as the big-endian bytes of its code points."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points) - k + 1
    if n < 1:
        return np.zeros(0, f"S{4 * k}")
    coded, letters, width = points, None, int(points.max()).bit_length()
    if width * k > 63:
        letters = distinct(points)
        coded, width = np.searchsorted(letters, points), (len(letters) - 1).bit_length()
    if width * k > 63:  # too many letters for one number
        cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(points.astype(">u4"), k))
        return np.unique(cut.view(f"S{4 * k}").ravel())
    coded, numbers = coded.astype(np.int64), np.zeros(n, np.int64)
    for j in range(k):  # a window is one number, in the order of its bytes
        numbers <<= width
        numbers |= coded[j : j + n]
    numbers = distinct(numbers)
    cut = np.empty((len(numbers), k), ">u4")
    for j in range(k):
        digit = (numbers >> (width * (k - 1 - j))) & ((1 << width) - 1)
        cut[:, j] = digit if letters is None else letters[digit]
    return cut.view(f"S{4 * k}").ravel()


def _scattered(windows: np.ndarray) -> np.ndarray:
    """A number for each window, to order rare ones and deal all without regard to the alphabet."""
    if not len(windows):
        return np.zeros(0, np.uint64)
    points = windows.view(">u4").reshape(len(windows), -1).T.astype(np.uint64)
    mixed = np.zeros(len(windows), np.uint64)
    for column in points:
        mixed = (mixed ^ column) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _binary(windows: np.ndarray, k: int) -> pa.Array:
    """Windows as binary values of equal length."""
    data = np.ascontiguousarray(windows).view(np.uint8)
    offsets = np.arange(len(windows) + 1, dtype=np.int32) * (4 * k)
    return pa.BinaryArray.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def text_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """Equal texts of ``scope, id, text``, blanks collapsed, as one row: ``no, scope, id, copies, text``.

    ``id`` is the smallest; texts shorter than a shingle have no row. A group of
    copies of any size is one row from here on.
    """
    text = collapse_space(F.col("text"))
    grouped = docs.where(F.col("text").isNotNull()).select("scope", "id", text.alias("text")).groupBy("scope", "text").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    # lengths are judged on the table: in front of it, blanks would be collapsed once more for them
    return materialize(grouped.select(
        F.monotonically_increasing_id().alias("no"), "scope", "id", "copies", "text"
    ), "text-classes").where(F.length("text") >= k)


def frequent_shingles(classes: DataFrame, k: int, most: int = FREQUENT) -> np.ndarray:
    """The ``most`` shingles that the most texts hold, rarest first: a bounded list."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_windows(t.as_py(), k) for t in batch.column("text")]
            if held:
                seen, times = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([_binary(seen, k), pa.array(times)], ["shingle", "n"])

    counted = classes.select("text").mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").collect()
    return np.array([bytes(r.shingle) for r in rows[::-1]], f"S{4 * k}")


def prefixes(classes: DataFrame, frequent: np.ndarray, percent: int, k: int) -> DataFrame:
    """``no, scope, size, place, key, before``: the prefix of every set, and the shingle before each of its own."""
    order = np.argsort(frequent)
    shipped = classes.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shipped.value
        for batch in batches:
            for row in range(batch.num_rows):
                windows = _windows(batch.column("text")[row].as_py(), k)
                rank = np.full(len(windows), -1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
                    rank = np.where(known[at] == windows, ranks[at], -1)
                kept = len(windows) - -(-percent * len(windows) // 100) + 1
                scattered = _scattered(windows)
                keys = scattered[np.lexsort((windows, scattered, rank))[:kept]].view(np.int64)
                before = pa.array(np.roll(keys, 1), mask=np.arange(kept) == 0)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(kept, batch.column("no")[row].as_py())), batch.column("scope").take(pa.array(np.full(kept, row))),
                    pa.array(np.full(kept, len(windows)), pa.int32()), pa.array(np.arange(kept), pa.int32()), pa.array(keys), before,
                ], ["no", "scope", "size", "place", "key", "before"])

    schema = f"no long, scope {classes.schema['scope'].dataType.simpleString()}, size int, place int, key long, before long"
    return classes.select("no", "scope", "text").mapInArrow(run, schema)


def prefix_candidates(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Distinct ``no_a, no_b`` of sets that may reach ``percent``, by length and place in the prefix.

    At the first shingle that two prefixes share, at most the shorter rest can be
    shared behind it. Where the shingles before are the same as well, it is not the
    first one, and the row would only repeat the pair.
    """
    index = materialize(prefixes(classes, frequent_shingles(classes, k), percent, k), "prefix-index")
    met = bucket_pairs(index, ["scope", "key"], "no")
    sizes = F.col("a_size") + F.col("b_size")
    behind = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))  # itself included
    return met.where(
        (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
        & ((100 + percent) * behind >= percent * sizes)
        & (F.col("a_before").isNull() | F.col("b_before").isNull() | (F.col("a_before") != F.col("b_before")))
    ).select(F.least("a_no", "b_no").alias("no_a"), F.greatest("a_no", "b_no").alias("no_b")).distinct()


def _sketch_bits(band: int, percent: int) -> int:
    """Width of the sketches of a band: a power of two, some three times what similar sets differ in and 64 at least."""
    apart = 2 * 2 ** ((band + 1) / BANDS) * (100 - percent) / (100 + percent)
    return 1 << max(6, math.ceil(math.log2(max(3 * apart, 1))))


def sketches(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """``no, scope, band, size, sketch`` of every text: its number of shingles and the parities of their numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands, packed = [], [], []
            for text in batch.column("text"):
                windows = _windows(text.as_py(), k)
                sizes.append(len(windows))
                bands.append(math.floor(BANDS * math.log2(len(windows))))
                bits = _sketch_bits(bands[-1], percent)
                odd = np.bincount((_scattered(windows) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                packed.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), batch.column("scope"), pa.array(bands, pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())],
                ["no", "scope", "band", "size", "sketch"],
            )

    schema = f"no long, scope {classes.schema['scope'].dataType.simpleString()}, band int, size int, sketch binary"
    return classes.select("no", "scope", "text").mapInArrow(run, schema)


def _opened(tile: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sizes and sketches (as words) of a tile, by size."""
    rows = tile.values.flatten()
    nos, sizes = (rows[i].to_numpy(zero_copy_only=False) for i in range(2))
    words = np.frombuffer(b"".join(rows[2].to_pylist()), "<u8").reshape(len(nos), -1)
    order = np.argsort(sizes, kind="stable")
    return nos[order], sizes[order].astype(np.int64), words[order]


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches of ``width`` words from wider ones."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


def _near(left: tuple, right: tuple, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of two tiles that sizes and sketches allow to reach ``percent``; of one with itself, each pair once."""
    (nos_a, sizes_a, words_a), (nos_b, sizes_b, words_b) = left, right
    width = min(words_a.shape[1], words_b.shape[1])
    words_a, words_b = _folded(words_a, width), np.ascontiguousarray(_folded(words_b, width).T)
    most = lambda total: total - 2 * -(-percent * total // (100 + percent))  # noqa: E731  shingles that similar sets differ in
    step, found_a, found_b = max(1, (1 << 16) // len(nos_b)), [], []
    for start in range(0, len(nos_a), step):
        rows = slice(start, start + step)
        low, high = int(sizes_a[rows][0]), int(sizes_a[rows][-1])
        first = max(start if same else 0, int(np.searchsorted(sizes_b, -(-percent * low // 100))))
        last = int(np.searchsorted(sizes_b, 100 * high // percent, "right"))
        if first >= last:
            continue
        apart = np.zeros((len(sizes_a[rows]), last - first), np.uint32 if width > 1000 else np.uint16)
        for j in range(width):
            apart += np.bitwise_count(words_a[rows, j, None] ^ words_b[None, j, first:last])
        a, b = np.nonzero(apart <= (high + int(sizes_b[last - 1])) * (100 - percent) // (100 + percent))
        differ, a, b = apart[a, b], a + start, b + first
        x, y = sizes_a[a], sizes_b[b]
        kept = (differ <= most(x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        if same:
            kept &= a < b
        found_a.append(nos_a[a[kept]])
        found_b.append(nos_b[b[kept]])
    return tuple(np.concatenate([np.zeros(0, np.int64), *found]) for found in (found_a, found_b))


def sketch_candidates(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """``no_a, no_b`` of sets that may reach ``percent``, by size and sketch; each pair once.

    Sets of one scope and band are dealt to tiles of bounded size. A tile meets those of
    its own band behind it and of the next few bands, as far as sizes may differ: a cell
    holds two tiles, and a tile is sent once a cell. All of a band's pairs are compared, some
    dozens of words each, and none is written but those that may be similar.
    """
    spark = classes.sparkSession
    reach = math.floor(BANDS * math.log2(100 / percent)) + 1
    sketched = materialize(sketches(classes, percent, k), "sketches")
    bits = F.max(8 * F.length("sketch"))
    bands = materialize(sketched.groupBy("scope", "band").agg(
        F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.lit(TILE_BITS) / bits))).cast("int").alias("parts")
    ), "sketch-bands")
    tiles = materialize(
        sketched.hint("merge").join(bands, ["scope", "band"])
        .withColumn("part", F.pmod(F.xxhash64("no"), "parts").cast("int"))
        .groupBy("scope", "band", "part").agg(F.collect_list(F.struct("no", "size", "sketch")).alias("tile")), "sketch-tiles",
    )
    slots = max(2 * spark.sparkContext.defaultParallelism, min(tiles.count(), 4096))
    others = bands.select("scope", F.col("band").alias("band_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"))
    left = tiles.select(
        "scope", F.col("band").alias("band_a"), F.col("part").alias("part_a"), F.col("tile").alias("a"),
        F.explode(F.sequence(F.col("band"), F.col("band") + reach)).alias("band_b"),
    ).join(others, ["scope", "band_b"]).where((F.col("band_a") < F.col("band_b")) | (F.col("part_a") <= F.col("part_b")))
    right = tiles.select("scope", F.col("band").alias("band_b"), F.col("part").alias("part_b"), F.col("tile").alias("b"))
    key = ["scope", "band_b", "part_b"]
    cells = left.repartition(slots, *key).hint("merge").join(right.repartition(slots, *key), key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = _near(_opened(batch.column("a")[i]), _opened(batch.column("b")[i]), percent, batch.column("same")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["no_a", "no_b"])

    same = (F.col("band_a") == F.col("band_b")) & (F.col("part_a") == F.col("part_b"))
    return cells.select("a", "b", same.alias("same")).mapInArrow(compare, "no_a long, no_b long")


def overlaps(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``scope, id_a < id_b, copies_a, copies_b, shared, size_a, size_b`` of pairs ``no_a, no_b``."""
    def side(s: str) -> DataFrame:
        return classes.select(F.col("no").alias(f"no_{s}"), F.struct("scope", "id", "copies", "text").alias(s))

    swap = F.col("a.id") > F.col("b.id")
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    joined = pairs.join(side("a"), "no_a").join(side("b"), "no_b").select(first.alias("a"), second.alias("b")).select(
        "a.scope", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"),
        F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"),
        F.col("a.text").alias("_text_a"), F.col("b.text").alias("_text_b"),
    )
    return with_overlap(joined, k).withColumnsRenamed({"_shared": "shared", "_a": "size_a", "_b": "size_b"})


@dataclass(frozen=True)
class Similar:
    """``pairs(scope, id_a, id_b, jaccard, copies_a, copies_b)`` between classes of equal
    texts and ``classes``; a class of n copies stands for n(n-1)/2 further pairs."""

    pairs: DataFrame
    classes: DataFrame


def exact_pairs(
    docs: DataFrame, percent: int = 85, k: int = 5, propose: Callable[[DataFrame, int, int], DataFrame] = sketch_candidates
) -> Similar:
    """All pairs of different texts of ``scope, id, text`` whose shingle sets overlap by ``percent`` or more.

    ``propose`` is ``sketch_candidates`` or ``prefix_candidates``; both lose no pair.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie in 1..100")
    classes = text_classes(docs, k)
    proposed = materialize(propose(classes, percent, k), "similar-candidates")
    compared = overlaps(proposed, classes, k)
    union = F.col("size_a") + F.col("size_b") - F.col("shared")
    pairs = compared.where(100 * F.col("shared") >= percent * union).select(
        "scope", "id_a", "id_b", (F.col("shared") / union).alias("jaccard"), "copies_a", "copies_b"
    )
    return Similar(materialize(pairs, "similar-pairs"), classes)


def _estimated(found: minhash.Duplicates) -> DataFrame:
    """``no_a, no_b`` of all pairs that ``found`` stands for, those inside a class of one signature too."""
    repeated = found.classes.where(F.col("copies") > 1).select("scope", F.col("id").alias("no"), F.col("id").alias("_class"))
    members = repeated.unionByName(found.copies.select("scope", F.col("id").alias("no"), F.col("representative").alias("_class")))
    pairs = found.pairs.select("scope", "id_a", "id_b")
    for end in ("a", "b"):
        held = members.select("scope", F.col("_class").alias(f"id_{end}"), F.col("no").alias(f"no_{end}"))
        pairs = pairs.join(held, ["scope", f"id_{end}"], "left").withColumn(f"no_{end}", F.coalesce(f"no_{end}", f"id_{end}"))
    within = bucket_pairs(members, ["scope", "_class"], "no").select(F.col("a_no").alias("no_a"), F.col("b_no").alias("no_b"))
    both = pairs.select("no_a", "no_b").unionByName(within)
    return both.select(F.least("no_a", "no_b").alias("no_a"), F.greatest("no_a", "no_b").alias("no_b"))


def links(docs: DataFrame, percent: int = 85, num_perm: int = 128, k: int = 5) -> DataFrame:
    """``scope, id_a, id_b, jaccard``: all links between ``scope, id, text`` rows.

    Equal texts, blanks collapsed, are one class with the smallest id. There is a row for each
    pair of classes that reaches ``percent`` by its shingle sets or by the estimate of
    ``minhash.duplicates``, and one for each other id of a class with the smallest. Where several
    rows have the id of a class, its pairs are listed for each of them.
    """
    classes = text_classes(docs, k)
    numbered = classes.select("scope", F.col("no").alias("id"), "text")
    estimated = _estimated(minhash.duplicates(numbered, percent / 100, num_perm, k)).withColumn("_estimated", F.lit(True))
    proposed = sketch_candidates(classes, percent, k).withColumn("_estimated", F.lit(False))
    # numbers hold for all scopes, and pairs lie in one
    pairs = materialize(estimated.unionByName(proposed).groupBy("no_a", "no_b").agg(F.max("_estimated").alias("_estimated")), "proposed-links").select(
        F.lit("").alias("scope"), F.col("no_a").alias("id_a"), F.col("no_b").alias("id_b"), "_estimated"
    )
    compared = minhash.exact_jaccard(pairs, numbered.withColumn("scope", F.lit("")), k)
    linked = compared.where(F.col("_estimated") | (F.col("jaccard") >= percent / 100)).select("id_a", "id_b", "jaccard")

    def side(s: str) -> DataFrame:
        return classes.select(F.col("no").alias(f"id_{s}"), F.struct("scope", "id").alias(s))

    swap = F.col("a.id") > F.col("b.id")
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    between = linked.join(side("a"), "id_a").join(side("b"), "id_b").select(
        "a.scope", first["id"].alias("id_a"), second["id"].alias("id_b"), "jaccard"
    )
    times = docs.groupBy("scope", "id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") > 1)
    for end in ("a", "b"):
        between = between.join(times.select("scope", F.col("id").alias(f"id_{end}"), F.col("n").alias(f"n_{end}")), ["scope", f"id_{end}"], "left")
    rows = F.sequence(F.lit(1), F.coalesce("n_a", F.lit(1)) * F.coalesce("n_b", F.lit(1)))
    between = between.withColumn("_row", F.explode(rows)).select("scope", "id_a", "id_b", "jaccard")
    repeated = classes.where(F.col("copies") > 1).select(F.col("scope").alias("_scope"), F.col("text").alias("_text"), F.col("id").alias("id_a"))
    # null-safe, since a filter for null texts would collapse their blanks once more
    copied = docs.select("scope", F.col("id").alias("id_b"), collapse_space(F.col("text")).alias("text")).join(
        repeated, F.col("text").eqNullSafe(F.col("_text")) & (F.col("scope") == F.col("_scope"))
    ).where(~F.col("id_a").eqNullSafe(F.col("id_b")))
    return between.unionByName(copied.select("scope", "id_a", "id_b", F.lit(1.0).alias("jaccard")).distinct())


def recall(exact: DataFrame, found: DataFrame, representatives: DataFrame) -> DataFrame:
    """``scope, exact_pairs, found_pairs, recall`` of an estimate against the exact pairs.

    ``found`` has pairs ``scope, id_a, id_b`` between classes of the estimate, and
    ``representatives`` ``scope, id, representative`` for ids that another one stands
    for. A pair within one class is found.
    """
    pairs = exact.select("scope", "id_a", "id_b")
    for end in ("a", "b"):
        renamed = representatives.select("scope", F.col("id").alias(f"id_{end}"), F.col("representative").alias(f"_{end}"))
        pairs = pairs.join(renamed, ["scope", f"id_{end}"], "left").withColumn(f"_{end}", F.coalesce(f"_{end}", f"id_{end}"))
    ends = pairs.select("scope", F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b"))
    known = found.select("scope", "id_a", "id_b").withColumn("_known", F.lit(True))
    judged = ends.join(known, ["scope", "id_a", "id_b"], "left").select(
        "scope", (F.col("id_a") == F.col("id_b")) | F.col("_known").isNotNull()
    ).toDF("scope", "hit")
    return judged.groupBy("scope").agg(
        F.count(F.lit(1)).alias("exact_pairs"), F.count_if("hit").alias("found_pairs"),
        F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("recall"),
    )
