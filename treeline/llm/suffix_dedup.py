"""Suffix-array dedup with a logarithmic family of sorted suffix tables.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts
somewhere else, in the same document or another.

Suffixes are sampled: of the 337 starts of ``HEAD`` bytes inside a string of 400,
the one with the least hash (the leftmost of equal ones) is the string's anchor.
Equal strings have equal anchors, so it is enough to index the suffixes that
start at anchors, about one in 170 bytes. Consecutive strings with one anchor
form a stretch; equal stretches are one entry of the index.

Documents arrive in batches. A batch's suffix table is sorted by the fingerprint
of the suffix's first ``HEAD`` bytes, merge-scanned against every level for heads
that occur there too, and becomes a level; before the next batch, two levels of one size merge
into one of twice the size, so an entry is rewritten a logarithmic number of times.

Stretches with a head that occurs twice are then compared:

- a stretch that occurs twice is repeated as a whole, wherever it occurs,
- where different stretches share a head, one occurrence of each is cut out. First
  it lists a 128-bit fingerprint per band of 48 neighbouring strings, of the bytes
  that all of them hold; then the strings of bands that two stretches share list
  theirs, and strings in two stretches are repeated.

Fingerprints of bytes decide equality (64 bits for heads, 128 for stretches and
strings). Nothing is paired: all comparisons are aggregations, and keys with many
rows are salted before joins.

Null texts count as empty. Documents below ``LENGTH`` bytes lose nothing. Rows
equal in id and text are separate documents, so their long strings are repeated.
Very long texts are read in pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.llm.skew import for_every_salt, hot_among, salted
from treeline.llm.store import discard, row_key, stored
from treeline.llm.words import SECOND, prefix_hashes, span_hashes, text_buffers

LENGTH, HEAD, BATCHES = 400, 64, 4
BAND = 48  # neighbouring strings that are first compared by what they have in common
_PIECE = 1 << 19  # windows hashed at once
_PLACE_BITS = np.uint64(21)  # places inside a piece

_STRETCH = "key binary, start int, windows int, shift int, head long, whole long"
_NAME = ["head", "whole"]  # names a stretch


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, start in it, windows, place of the anchor, head and whole fingerprint of every stretch."""
    found = []
    for begin in range(0, max(1, len(data) - LENGTH + 1), _PIECE):
        part = data[begin : begin + _PIECE + LENGTH - 1]
        windows = len(part) - LENGTH + 1
        if windows < 1:
            break
        sums = prefix_hashes(part)
        at = np.arange(len(part) - HEAD + 1)
        heads = span_hashes(sums, at, at + HEAD)
        placed = (heads >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        anchor = (_least(placed, LENGTH - HEAD + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        # windows inside one text
        place = np.arange(begin, begin + windows)
        text = np.searchsorted(offsets, place, "right") - 1
        valid = place + LENGTH <= offsets[np.minimum(text + 1, len(offsets) - 1)]
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        if not len(start):
            continue
        count = np.add.reduceat(valid.astype(np.int64), start)
        whole = span_hashes(prefix_hashes(part, SECOND), start, start + count + LENGTH - 1)
        found.append((
            text[start], begin + start - offsets[text[start]], count, anchor[start] - start,
            heads[anchor[start]].view(np.int64), whole.view(np.int64),
        ))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(column) for column in zip(*found))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for row, data, offsets in text_buffers(batch.column("text"), 1 << 16):
            text, *facts = stretches(data, offsets)
            found.append((text + row, *facts))
        if not found:
            continue
        text, start, windows, shift, head, whole = (np.concatenate(column) for column in zip(*found))
        yield pa.RecordBatch.from_arrays([
            batch.column("key").take(pa.array(text)), pa.array(start.astype(np.int32)),
            pa.array(windows.astype(np.int32)), pa.array(shift.astype(np.int32)), pa.array(head), pa.array(whole),
        ], names=["key", "start", "windows", "shift", "head", "whole"])


@dataclass
class SuffixLevels:
    """Sorted suffix tables ``head, whole, copies`` with their sizes, largest first, and the heads found twice."""

    spark: SparkSession
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    matched: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def _table(entries: DataFrame, size: int) -> DataFrame:
        merged = entries.groupBy("head", "whole").agg(F.sum("copies").alias("copies"))
        return stored(merged.sortWithinPartitions("head", "whole"), f"suffixes-{size}")

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, new), (_, old) = self.levels.pop(), self.levels.pop()
            self.levels.append((size + 1, self._table(new.unionByName(old), size + 1)))
            discard(old)
            discard(new)

    def add(self, batch: DataFrame) -> None:
        """Take in the stretches ``head, whole`` of a batch."""
        self._merge()
        new = self._table(batch.select("head", "whole", F.lit(1).cast("long").alias("copies")), 0)
        heads = new.groupBy("head").agg(F.sum("copies").alias("copies"))
        self.matched.append(stored(heads.where("copies > 1"), "batch-matches"))
        for _, level in self.levels:
            there = level.select("head").distinct()
            both = heads.select("head").join(there, "head").withColumn("copies", F.lit(0).cast("long"))
            self.matched.append(stored(both, "level-matches"))
        self.levels.append((0, new))

    def repeated_heads(self) -> DataFrame:
        """``head, copies``; a batch with one of the copies does not count it."""
        everything = self.matched[0]
        for more in self.matched[1:]:
            everything = everything.unionByName(more)
        return stored(everything.groupBy("head").agg(F.sum("copies").alias("copies")), "repeated-heads")


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number within the row, for rows of ``counts`` entries."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed stretches."""
    for batch in batches:
        listed = batch.column("listed")
        one, cuts = listed.flatten(), []
        begins = _numbers(one.field("start"))
        spans = zip(begins.tolist(), (begins + _numbers(one.field("windows")) + LENGTH - 1).tolist())
        texts = (batch.column(c).to_pylist() for c in ("packed", "n_bytes"))
        for packed, n, count in zip(*texts, pc.list_value_length(listed).to_pylist()):
            data = pa.decompress(packed, n, "zstd", asbytes=True)
            cuts += [data[begin:end] for begin, end in islice(spans, count)]
        names = [*_NAME, "windows", "shift"]
        yield pa.RecordBatch.from_arrays([*[one.field(c) for c in names], pa.array(cuts, pa.binary())], names=[*names, "bytes"])


def _fingerprints(all_bands: bool):
    """Per row ``first, second`` (128 bits), ``head, whole`` and ``at``: what the strings of a band share, or each string of listed bands.

    Band b of a stretch holds the strings that start b*BAND to b*BAND+BAND-1 before the anchor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                segments = batch.column("bytes").cast(pa.large_binary())
                offsets = np.frombuffer(segments.buffers()[1], np.int64)[segments.offset : segments.offset + len(segments) + 1]
                data = np.frombuffer(segments.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                windows, shift = (_numbers(batch.column(c)) for c in ("windows", "shift"))
                if all_bands:
                    least = np.maximum(0, shift - windows + 1) // BAND
                    row, step = _expanded(shift // BAND - least + 1)
                    at = least[row] + step
                    # the strings of band b all hold the bytes from b*BAND before the anchor on
                    starts = shift[row] - at * BAND
                    ends = starts + LENGTH - BAND + 1
                else:
                    listed = batch.column("bands")
                    band, row = _numbers(listed.flatten()), _numbers(pc.list_parent_indices(listed))
                    low = np.maximum(0, shift[row] - band * BAND - BAND + 1)
                    entry, step = _expanded(np.minimum(windows[row], shift[row] - band * BAND + 1) - low)
                    at = starts = low[entry] + step
                    row, ends = row[entry], starts + LENGTH
                place = offsets[row] - offsets[0]
                prints = [
                    pa.array(span_hashes(sums, place + starts, place + ends).view(np.int64))
                    for sums in (prefix_hashes(data), prefix_hashes(data, SECOND))
                ]
                named = [batch.column(c).take(pa.array(row)) for c in _NAME]
                yield pa.RecordBatch.from_arrays(
                    [*prints, *named, pa.array(at.astype(np.int32))], names=["first", "second", *_NAME, "at"]
                )

    return run


def _as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window numbers as runs of first and last."""
    for batch in batches:
        at = batch.column("at")
        row, values = _numbers(pc.list_parent_indices(at)), _numbers(at.flatten())
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (np.diff(values) > 1) | (np.diff(row) > 0)
        edges = np.flatnonzero(new)
        firsts, lasts = (pa.array(values[k].astype(np.int32)) for k in (edges[:-1], edges[1:] - 1))
        bounds = np.searchsorted(row[edges[:-1]], np.arange(batch.num_rows + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([firsts, lasts], ["first", "last"]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAME], runs], names=[*_NAME, "runs"])


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, which halves what the joins by key move."""
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("key"), pa.array([len(r) for r in raw], pa.int64()),
            pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary()),
        ], names=["doc_id", "key", "n_bytes", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("packed", "n_bytes", "spans")))
        for packed, n, spans in rows:
            data = np.frombuffer(pa.decompress(packed, n, "zstd"), np.uint8)
            if not spans:
                kept.append(data.tobytes())
                removed.append([])
                continue
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, [s["first"] for s in spans], 1)
            np.add.at(steps, [s["last"] + 1 for s in spans], -1)
            gone = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept.append(data[~gone].tobytes())
            removed.append([{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, _RUNS), pa.array(kept, pa.binary()),
        ], names=["doc_id", "n_bytes", "removed", "kept"])


def _verdicts(suspects: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``head, whole, runs`` (repeated windows) of the stretches that have some; the hot ones of all ``suspects``."""
    classes = stored(suspects.groupBy(*_NAME).agg(
        F.count("*").alias("copies"), F.max("windows").alias("windows")
    ), "stretch-classes")
    hot_names = hot_among(classes, _NAME, suspects.count())
    contested = stored(classes.groupBy("head").agg(F.count("*").alias("copies")).where("copies > 1"), "contested")
    hot = hot_among(contested, "head", classes.count())
    rivals = stored(salted(classes, "head", hot, "whole").join(
        for_every_salt(contested.select("head"), "head", hot), ["head", "salt"]
    ).select(*_NAME), "rivals")
    # one occurrence of each, listed by document
    own = salted(suspects, _NAME, hot_names, "key", "start").join(
        for_every_salt(rivals, _NAME, hot_names), [*_NAME, "salt"]
    )
    place = F.struct("key", "start", "windows", "shift")
    shown = own.groupBy(*_NAME, "salt").agg(F.min(place).alias("place")).groupBy(*_NAME).agg(F.min("place").alias("place"))
    listed = shown.groupBy(F.col("place.key").alias("key")).agg(F.collect_list(
        F.struct(*_NAME, "place.start", "place.windows", "place.shift")
    ).alias("listed"))
    # rows equal in id and text have one key and are cut once
    once = packed.select("key", "n_bytes", "packed").join(listed, "key").dropDuplicates(["key"])
    segments = stored(once.select("packed", "n_bytes", "listed").mapInArrow(
        _segments, "head long, whole long, windows int, shift int, bytes binary"
    ), "segments")
    bands = stored(segments.mapInArrow(_fingerprints(True), _PRINT), "bands")
    likely = _twice(bands).groupBy(*_NAME).agg(F.collect_list("at").alias("bands"))
    strings = stored(segments.join(likely, _NAME).mapInArrow(_fingerprints(False), _PRINT), "strings")
    discard(bands)
    discard(segments)
    partial = _twice(strings).groupBy(*_NAME).agg(F.collect_list("at").alias("at")).mapInArrow(
        _as_runs, "head long, whole long, runs array<struct<first:int,last:int>>"
    )
    whole = classes.where("copies > 1").select(*_NAME, F.array(F.struct(
        F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")
    )).alias("runs"))
    rest = partial.join(whole, _NAME, "left_anti")
    verdicts = stored(whole.unionByName(rest), "verdicts")
    for table in (strings, rivals, contested, classes):
        discard(table)
    return verdicts, hot_names


_PRINT = "first long, second long, head long, whole long, at int"


def _twice(prints: DataFrame) -> DataFrame:
    """``head, whole, at`` of the fingerprints that occur more than once; AQE splits a frequent one."""
    key = ["first", "second"]
    twice = stored(prints.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1").select(*key), "twice")
    return prints.join(twice, key).select(*_NAME, "at")


def repeated_strings(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` of every row of ``documents (doc_id, text)``.

    ``removed`` are the maximal runs of removed bytes (first and last place),
    ``kept`` the bytes that are left.
    """
    spark = documents.sparkSession
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"
    )
    found = stored(
        texts.select("key", "text").mapInArrow(_index, _STRETCH)
        .withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")), "stretches", "batch",
    )
    index = SuffixLevels(spark)
    for number in range(batches):
        index.add(found.where(F.col("batch") == number))
    repeated = index.repeated_heads()
    hot = hot_among(repeated, "head", found.count())
    suspects = stored(salted(found.drop("batch"), "head", hot, "key", "start").join(
        for_every_salt(repeated.select("head"), "head", hot), ["head", "salt"]
    ).drop("salt"), "suspects")
    for table in (found, *[level for _, level in index.levels]):
        discard(table)
    packed = texts.mapInArrow(_packed, "doc_id long, key binary, n_bytes long, packed binary")
    verdicts, hot_names = _verdicts(suspects, packed)
    # rows equal in id and text have one key: their spans count once, and each row gets that list
    named = suspects.select("key", "start", *_NAME).distinct()
    spans = salted(named, _NAME, hot_names, "key", "start").join(
        for_every_salt(verdicts, _NAME, hot_names), [*_NAME, "salt"]
    ).select("key", F.transform("runs", lambda r: F.struct(
        (F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"] + LENGTH - 1).alias("last")
    )).alias("spans"))
    by_document = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return packed.join(by_document, "key", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, removed array<struct<first:int,last:int>>, kept binary"
    )
