"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of 10 words of a benchmark item, or the whole item where it
has fewer. The text's symbols are its words; a block is two words (one for
patterns of one word). Patterns of one length share three tables:

- ``shift``: how far the window may move for the block at its end, 0 where the
  block ends a pattern, and the whole window less a word for blocks of no pattern,
- ``buckets``: the patterns by the hash of their last block,
- the pattern's bytes, compared with the text's own bytes at every candidate.

Many texts are searched side by side: every lane is a stretch of one text and
moves by its own shift.

Patterns go out in blocks of at most ``block_patterns`` (pattern, item) rows,
which bounds what a task holds; every block runs over all documents and the hits
of a document are merged.

Null and empty texts have no words, null item ids are ignored, an item repeated
under one id counts once, and equal items under several ids all count. Without
documents there are no rows, without items nothing is hit. Documents with equal
id and text give one row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from treeline.llm.store import row_key, stored
from treeline.llm.words import Words, mixed, text_buffers, words

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_TABLE_BITS = 20
_LANE = 512  # words

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True

def windows(benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct ``item, pattern`` of ``benchmark (item_id, text)``; words joined by one blank."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_WORD), F.lit(1))
    split = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item"), found.alias("w")
    ).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    return split.select(
        "item", F.explode_outer(F.transform(at, lambda i: F.array_join(F.slice("w", i, length), " "))).alias("pattern")
    ).distinct()


def _block(hashes: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words up to and with ``end``."""
    if size == 1:
        return hashes[end]
    return mixed(hashes[end - 1] * np.uint64(3) + hashes[end])


class _Tables:
    """Shift table, suffix buckets and patterns of one length."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray, length: int):
        self.length, self.size = length, min(2, length)
        joined = b"\n".join(patterns)
        data = np.frombuffer(joined, np.uint8)
        hashes = words(data, np.array([0, len(data)]), _IS_WORD).hashes.reshape(len(patterns), length)
        widest = length - self.size + 1
        self.shift = np.full(1 << _TABLE_BITS, widest, np.uint8)
        for end in range(self.size - 1, length):  # later blocks allow smaller shifts and overwrite
            self.shift[self._slot(_block(hashes.T, end, self.size))] = length - 1 - end
        last = _block(hashes.T, length - 1, self.size)
        order = np.argsort(last, kind="stable")
        self.suffix, self.hashes = last[order], hashes[order]
        self.patterns, self.numbers = [patterns[i] for i in order], numbers[order]

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def candidates(self, text: Words) -> np.ndarray:
        """Word numbers at which a pattern may end."""
        begin, end = text.first[:-1], text.first[1:]
        count = np.maximum(0, end - begin - self.length + 1)  # window positions of each text
        lanes = -(-count // _LANE)
        row = np.repeat(np.arange(len(begin)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[row] + nth * _LANE + self.length - 1
        stop = np.minimum(at + _LANE, end[row])
        found = []
        while len(at):
            step = self.shift[self._slot(_block(text.hashes, at, self.size))].astype(np.int64)
            if len(hit := at[step == 0]):
                found.append(hit)
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def matches(self, low: np.ndarray, text: Words) -> Iterator[tuple[int, int]]:
        """Last word and pattern number of every occurrence, confirmed by its bytes."""
        at = self.candidates(text)
        block = _block(text.hashes, at, self.size)
        left, right = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        width = right - left
        at, nth = np.repeat(at, width), np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        which = np.repeat(left, width) + nth
        same = self.hashes[which, 0] == text.hashes[at - self.length + 1]  # the prefix table
        for end, k in zip(at[same].tolist(), which[same].tolist()):
            run = range(end - self.length + 1, end + 1)
            if b" ".join(low[text.starts[i] : text.ends[i]].tobytes() for i in run) == self.patterns[k]:
                yield end, int(self.numbers[k])


def _search(patterns: list[str], items: list[list[str]]):
    encoded = [p.encode() for p in patterns]
    counts = np.array([p.count(b" ") + 1 for p in encoded])
    built: list[_Tables] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            for length in np.unique(counts).tolist():
                own = np.flatnonzero(counts == length)
                built.append(_Tables([encoded[i] for i in own], own, length))
        for batch in batches:
            others = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            sizes, runs, hits = [], [], []
            for _, data, offsets in text_buffers(batch.column("text")):
                text = words(data, offsets, _IS_WORD)
                low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
                hit: dict[int, tuple[list, set]] = {}
                for table in built:
                    for end, number in table.matches(low, text):
                        doc = int(np.searchsorted(text.first, end, "right")) - 1
                        own, named = hit.setdefault(doc, ([], set()))
                        own.append((end - table.length + 1 - int(text.first[doc]), end - int(text.first[doc])))
                        named.update(items[number])
                sizes.append(np.diff(text.first))
                for doc in range(len(offsets) - 1):
                    own, named = hit.get(doc, ((), ()))
                    runs.append([{"first": a, "last": b} for a, b in _merged(own)])
                    hits.append(sorted(named))
            found = [pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(runs, _RUNS)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in others), *found, pa.array(hits, pa.list_(pa.string()))],
                names=[*(batch.schema.names[i] for i in others), "n_words", "runs", "items"],
            )

    return run


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_RESULT = StructType().add("n_words", "long").add(
    "runs", ArrayType(StructType().add("first", "integer").add("last", "integer"))
).add("items", ArrayType(StringType()))


def _merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _union_length(runs: Column) -> Column:
    """Words in the union of the runs, which may overlap where blocks were merged."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))
    return F.aggregate(F.array_sort(runs), start, lambda s, r: F.struct(
        (s["n"] + F.greatest(r["last"] - F.greatest(s["upto"], r["first"] - 1), F.lit(0))).alias("n"),
        F.greatest(s["upto"], r["last"]).alias("upto"),
    ), lambda s: s["n"])


def _blocks(benchmark: DataFrame, length: int, block_patterns: int) -> list:
    """A search for every block of (pattern, item) rows."""
    pairs = stored(windows(benchmark, length), "patterns")
    blocks = max(1, -(-pairs.count() // block_patterns))
    searches = []
    for number in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == number)
        by_pattern: dict[str, list[str]] = {}
        for item, pattern in own.select("item", "pattern").collect():  # about block_patterns rows
            by_pattern.setdefault(pattern, []).append(item)
        searches.append(_search(list(by_pattern), list(by_pattern.values())))
    return searches


def _searched(rows: DataFrame, search) -> DataFrame:
    """``rows`` with the hits in ``text`` in its place."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(search, StructType([*kept, *_RESULT.fields]))


def contamination(
    documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_patterns: int = 200_000
) -> DataFrame:
    """``doc_id, n_words, n_hit, runs, items`` for each row of ``documents (doc_id, text)``.

    ``runs`` are the hit words (first and last word number), ``items`` the sorted
    ids of the items with an occurring pattern.
    """
    searches = _blocks(benchmark, length, block_patterns)
    key = row_key(F.col("doc_id"), F.col("text")) if len(searches) > 1 else F.lit(b"")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    merged = _searched(texts, searches[0])
    if len(searches) > 1:
        for search in searches[1:]:
            merged = merged.unionByName(_searched(texts, search))
        # rows that agree in id and text agree in hits: merged once, then repeated as often as they came
        merged = stored(merged, "pattern-hits").groupBy("doc_id", "key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_set("runs")).alias("runs"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            (F.count("*") / len(searches)).cast("int").alias("rows"),
        ).withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("rows"))))
    return merged.select("doc_id", "n_words", _union_length(F.col("runs")).alias("n_hit"), "runs", "items")


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, length: int = WINDOW, block_patterns: int = 200_000
) -> DataFrame:
    """The rows of ``documents`` without a hit word; every block of patterns filters what the last one left."""
    left = documents
    for search in _blocks(benchmark, length, block_patterns):
        packed = left.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")
        left = _searched(packed, search).where(F.size("runs") == 0).select("row.*")
    return left
