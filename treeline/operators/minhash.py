"""Near-duplicates by MinHash.

A document's 128 slots estimate Jaccard similarity of its shingle set with
others as the share of equal slots. Candidate keys are complete for the
threshold: every pair whose estimate reaches it shares at least one key, so
the result does not depend on how the keys are cut.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from treeline.functions.text import collapsed, distinct, window_sets
from treeline.operators.buckets import bucket_pairs
from treeline.session import materialize

# Shingles are hashed as base-BASE numbers modulo PRIME.
BASE = 1_000_003
PRIME = 2**31 - 1

HELD_CHARS = 1 << 20  # of the texts whose shingle sets are held at once


def slot_parameters(num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiplier (odd) and offset of each slot, 32 bits, from md5 of its number."""
    digests = [hashlib.md5(f"slot-{i}".encode()).digest() for i in range(num_perm)]
    words = np.array([np.frombuffer(d, dtype="<u4") for d in digests])
    return words[:, 0] | np.uint32(1), words[:, 1]


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """One hash per k-character window."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    n = len(points) - k + 1
    hashes = np.zeros(max(n, 0), dtype=np.int64)
    for j in range(k if n > 0 else 0):
        hashes = (hashes * BASE + points[j : j + n]) % PRIME
    return hashes


class SlotMinima:
    """Smallest value of each slot function, a*h+b modulo 2**32, over a document's hashes.

    Works in blocks through one buffer that fits a core's cache and is kept
    from document to document; 32-bit words keep the loop in vector registers.
    """

    def __init__(self, num_perm: int, step: int = 512):
        multiplier, offset = slot_parameters(num_perm)
        self._multiplier, self._offset = multiplier[:, None], offset[:, None]
        self._step = step
        self._mixed = np.empty((num_perm, step), dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        values = hashes.astype(np.uint32)
        low = np.full(len(self._mixed), 2**32 - 1, dtype=np.uint32)
        for start in range(0, len(values), self._step):
            block = values[None, start : start + self._step]
            mixed = self._mixed[:, : block.shape[1]]
            np.multiply(self._multiplier, block, out=mixed)
            np.add(mixed, self._offset, out=mixed)
            np.minimum(low, mixed.min(axis=1), out=low)
        return low.view(np.int32)


def _fixed_lists(matrix: np.ndarray, value_type: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(matrix.ravel(), value_type)
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def signatures(docs: DataFrame, num_perm: int = 128, k: int = 5) -> DataFrame:
    """``scope, id, signature`` of every row of ``scope, id, text`` with a shingle."""
    usable = docs.select("scope", "id", "text").where(F.col("text").isNotNull())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = SlotMinima(num_perm)
        for batch in batches:
            hashes = [shingle_hashes(collapsed(t), k) for t in batch.column("text").to_pylist()]
            held = [i for i, found in enumerate(hashes) if len(found)]
            signed = [minima(distinct(hashes[i])) for i in held]
            matrix = np.array(signed, dtype=np.int32).reshape(-1, num_perm)
            rows = pa.array(held, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("scope").take(rows), batch.column("id").take(rows), _fixed_lists(matrix, pa.int32())],
                ["scope", "id", "signature"],
            )

    schema = T.StructType([
        *usable.schema.fields[:2], T.StructField("signature", T.ArrayType(T.IntegerType())),
    ])
    return usable.mapInArrow(sign, schema)


def signature_classes(signed: DataFrame) -> DataFrame:
    """Documents with one signature as a single row: ``no``, smallest ``id``, ``copies``.

    Everything after works on these rows, so a group of copies of any size
    counts once and is never paired out. The table is written, which fixes the
    numbers that stand for the classes in the larger tables to come.
    """
    grouped = signed.groupBy("scope", "signature").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    return materialize(grouped.withColumn("no", F.monotonically_increasing_id()), "signature-classes")


def copies(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Each further copy and the document that stands for it: ``scope, id, representative``.

    One side has one row per signature; AQE may split the other on a hot one.
    """
    repeated = classes.where(F.col("copies") > 1).select(
        "scope", "signature", F.col("id").alias("representative")
    )
    return signed.join(repeated, ["scope", "signature"]).where(
        F.col("id") != F.col("representative")
    ).select("scope", "id", "representative")


def allowed_misses(threshold: float, num_perm: int) -> int:
    """Most slots two signatures may differ in and still reach the threshold."""
    return num_perm - math.ceil(round(threshold * num_perm, 9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def candidate_keys(classes: DataFrame, threshold: float = 0.85, num_perm: int = 128) -> DataFrame:
    """``no, key, spare`` rows; signatures within the threshold meet on some key.

    With m misses allowed, slots fall into m // 2 + 1 blocks, so two signatures
    within the threshold differ in at most one slot of some block. A block gives
    one key for all its slots (``spare`` null) and one per slot left out, with
    that slot's value as ``spare``: two rows on such a key are a candidate only
    if their spares differ, so a block proposes a pair at most once.
    """
    blocks = min(allowed_misses(threshold, num_perm) // 2 + 1, num_perm)
    edges = np.linspace(0, num_perm, blocks + 1).astype(int)
    block_of = np.repeat(np.arange(blocks), np.diff(edges))
    salt = _mix(np.arange(1, num_perm + 1, dtype=np.uint64) << np.uint64(32))
    rows = classes.select("scope", "no", "signature")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("signature"), num_perm)
            parts = _mix(values.view(np.uint32).astype(np.uint64) ^ salt)
            whole = np.add.reduceat(parts, edges[:-1], axis=1)
            rest = _mix((whole[:, block_of] - parts) ^ salt)
            keys = np.concatenate([_mix(whole), rest], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _fixed_lists(keys, pa.int64())], [*batch.schema.names, "keys"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    return (
        rows.mapInArrow(keyed, schema)
        .select("scope", "no", "signature", F.posexplode("keys").alias("slot", "key"))
        .select(
            "no", F.xxhash64("scope", "key").alias("key"),
            F.get("signature", F.col("slot") - blocks).alias("spare"),
        )
    )


def candidates(classes: DataFrame, threshold: float = 0.85, num_perm: int = 128) -> DataFrame:
    """Distinct pairs ``no_a, no_b`` of classes that share a key."""
    keyed = materialize(candidate_keys(classes, threshold, num_perm), "candidate-keys")  # read twice below
    met = bucket_pairs(keyed, ["key"], "no").where(
        F.col("a_spare").isNull() | (F.col("a_spare") != F.col("b_spare"))
    )
    return met.select(
        F.least("a_no", "b_no").alias("no_a"), F.greatest("a_no", "b_no").alias("no_b")
    ).distinct()


def with_similarity(
    pairs: DataFrame, classes: DataFrame, num_perm: int = 128
) -> DataFrame:
    """``scope, id_a < id_b, copies_a, copies_b, estimate``, the share of equal slots."""
    def side(s: str) -> DataFrame:
        return classes.select(
            F.col("no").alias(f"no_{s}"), F.struct("scope", "id", "copies", "signature").alias(s)
        )

    kept = ["scope", "id_a", "id_b", "copies_a", "copies_b"]
    swap = F.col("a.id") > F.col("b.id")
    first, second = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    joined = (
        pairs.join(side("a"), "no_a").join(side("b"), "no_b")
        .where(F.col("a.scope") == F.col("b.scope"))
        .select(first.alias("a"), second.alias("b"))
        .select(
            "a.scope", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"),
            F.col("a.copies").alias("copies_a"), F.col("b.copies").alias("copies_b"),
            F.col("a.signature").alias("signature_a"), F.col("b.signature").alias("signature_b"),
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = _matrix(batch.column("signature_a"), num_perm) == _matrix(
                batch.column("signature_b"), num_perm
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(equal.sum(axis=1) / num_perm)],
                [*kept, "estimate"],
            )

    schema = T.StructType([
        *joined.schema.fields[: len(kept)], T.StructField("estimate", T.DoubleType()),
    ])
    return joined.mapInArrow(compare, schema)


@dataclass(frozen=True)
class Duplicates:
    """``pairs(scope,id_a,id_b,similarity,copies_a,copies_b)`` between signature classes
    and ``copies(scope,id,representative)`` inside them; together every duplicate pair."""

    docs: DataFrame
    pairs: DataFrame
    copies: DataFrame
    classes: DataFrame
    threshold: float
    k: int

    def stats(self) -> DataFrame:
        """Counts per scope. A pair of classes stands for the product of their
        copies, a class of n copies for n(n-1)/2 pairs; no pair is written out."""
        counts = (
            self.docs.select("scope", F.lit(1).alias("files"), F.lit(0).cast("bigint").alias("found"))
            .unionByName(self.classes.select(
                "scope", F.lit(0).alias("files"), F.expr("copies * (copies - 1) div 2").alias("found")
            ))
            .unionByName(self.pairs.select(
                "scope", F.lit(0).alias("files"), (F.col("copies_a") * F.col("copies_b")).alias("found")
            ))
        )
        return counts.groupBy("scope").agg(
            F.sum("files").alias("files_analyzed"), F.sum("found").alias("duplicate_pairs_found"),
            F.lit(self.threshold).alias("similarity_threshold"), F.lit(self.k).alias("shingle_size_k"),
        )


def scoped(docs: DataFrame, id_col: str, text_col: str, scope_col: str | None = None) -> DataFrame:
    """``scope, id, text``; duplicates are looked for inside one scope only."""
    scope = F.lit("") if scope_col is None else F.col(scope_col)
    return docs.select(scope.alias("scope"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def duplicates(
    docs: DataFrame, threshold: float = 0.85, num_perm: int = 128, k: int = 5
) -> Duplicates:
    """All pairs of ``scope, id, text`` rows whose estimated similarity reaches ``threshold``.

    Signatures and pairs are written once to the shared folder; texts are read once.
    """
    signed = materialize(signatures(docs, num_perm, k), "signatures")
    classes = signature_classes(signed)
    scored = with_similarity(candidates(classes, threshold, num_perm), classes, num_perm)
    pairs = scored.where(F.col("estimate") >= threshold).select(
        "scope", "id_a", "id_b", F.round("estimate", 4).alias("similarity"), "copies_a", "copies_b"
    )
    return Duplicates(
        docs, materialize(pairs, "duplicate-pairs"), copies(signed, classes), classes, threshold, k
    )


def exact_jaccard(pairs: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Add ``jaccard``, the true overlap of both texts' shingle sets.

    Only texts that occur in a pair are cut, after a join that leaves the other
    texts where they are when the list of ids is short.
    """
    ends = pairs.select("scope", F.col("id_a").alias("id")).unionByName(
        pairs.select("scope", F.col("id_b").alias("id"))
    ).distinct()
    texts = docs.join(materialize(ends, "paired-ids"), ["scope", "id"]).select("scope", "id", "text")

    def side(s: str) -> DataFrame:
        return texts.select("scope", F.col("id").alias(f"id_{s}"), F.col("text").alias(f"_text_{s}"))

    joined = pairs.join(side("a"), ["scope", "id_a"]).join(side("b"), ["scope", "id_b"]).select(
        *pairs.columns, "_text_a", "_text_b"
    )
    jaccard = (F.col("_shared") / (F.col("_a") + F.col("_b") - F.col("_shared"))).alias("jaccard")
    return with_overlap(joined, k).select(*pairs.columns, jaccard)


def _counts(texts: list[str], ends: list[tuple[int, int] | None], k: int) -> list[tuple[int | None, ...]]:
    """Common shingles and those of each text for pairs of places in ``texts``; nulls for no pair."""
    flat = [collapsed(t) for t in texts]
    wide = len(set().union(*flat)) ** k > 2**63  # sets of all texts together would be slow strings
    sets = [] if wide else window_sets(flat, k)
    counts = []
    for pair in ends:
        if pair is None:
            counts.append((None, None, None))
            continue
        a, b = window_sets([flat[i] for i in pair], k) if wide else (sets[i] for i in pair)
        both = np.concatenate([a, b])
        both.sort(kind="stable")  # two sorted runs
        counts.append((int((both[1:] == both[:-1]).sum()), len(a), len(b)))
    return counts


def with_overlap(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` with ``_shared, _a, _b`` in place of ``_text_a, _text_b``: common shingles and those of each text.

    Texts travel, not their sets, which are many times larger. A text of several pairs that
    follow one another is cut once for them.
    """
    kept = [f for f in pairs.schema.fields if f.name not in ("_text_a", "_text_b")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, known, ends, held = [], {}, [], 0
            for pair in zip(batch.column("_text_a").to_pylist(), batch.column("_text_b").to_pylist()):
                if None in pair:
                    ends.append(None)
                    continue
                held += sum(len(t) for t in pair if t not in known)
                ends.append(tuple(known.setdefault(t, len(known)) for t in pair))
                if held > HELD_CHARS:
                    counts += _counts(list(known), ends, k)
                    known, ends, held = {}, [], 0
            counts += _counts(list(known), ends, k)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], *[pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]],
                [*[f.name for f in kept], "_shared", "_a", "_b"],
            )

    counted = [T.StructField(c, T.IntegerType()) for c in ("_shared", "_a", "_b")]
    return pairs.mapInArrow(count, T.StructType([*kept, *counted]))


def shingle_counts(docs: DataFrame, k: int = 5) -> DataFrame:
    """``scope, id, shingles`` of every row of ``scope, id, text``: how many distinct ones; null without text."""
    rows = docs.select("scope", "id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [
                None if t is None else len(window_sets([collapsed(t)], k)[0]) for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("scope"), batch.column("id"), pa.array(counts, pa.int32())], ["scope", "id", "shingles"]
            )

    return rows.mapInArrow(count, T.StructType([*rows.schema.fields[:2], T.StructField("shingles", T.IntegerType())]))
