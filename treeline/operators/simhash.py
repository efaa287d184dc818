"""Near-duplicates by Simhash fingerprints and Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from treeline.functions.text import is_blank, word_chars
from treeline.operators.buckets import bucket_pairs
from treeline.session import materialize

BITS = 64
WIDTH = 3
_KNOWN_GRAMS = 1 << 18


class Fingerprints:
    """Sign of the weighted bit sums of a text's character trigrams.

    A gram's 64 bits are the low half of its md5. Trigrams repeat across texts,
    so their bits are kept, up to a bound.
    """

    def __init__(self):
        self._bits: dict[int, np.ndarray] = {}

    def _gram_bits(self, code: int) -> np.ndarray:
        bits = self._bits.get(code)
        if bits is None:
            gram = "".join(chr((code >> shift) & 0x1FFFFF) for shift in (42, 21, 0))
            bits = self._text_bits(gram)
            if len(self._bits) < _KNOWN_GRAMS:
                self._bits[code] = bits
        return bits

    @staticmethod
    def _text_bits(text: str) -> np.ndarray:
        digest = hashlib.md5(text.encode("utf-8")).digest()[8:]
        return np.unpackbits(np.frombuffer(digest, dtype=np.uint8))

    def __call__(self, text: str) -> int:
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        if len(points) < WIDTH:
            ones, total = self._text_bits(text).astype(np.int64), 1
        else:
            codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
            grams, counts = np.unique(codes, return_counts=True)
            bits = np.array([self._gram_bits(g) for g in grams.tolist()])
            ones, total = counts @ bits, int(counts.sum())
        # a bit is set when its sum of +1 and -1 is positive; a tie leaves it 0
        return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``scope, id, fingerprint`` of every ``scope, id, text`` row that is not blank."""
    usable = docs.where(~is_blank(F.col("text"))).select(
        "scope", "id", word_chars(F.col("text")).alias("t")
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fingerprint = Fingerprints()
        for batch in batches:
            signed = [fingerprint(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("scope"), batch.column("id"), pa.array(signed, pa.int64())],
                ["scope", "id", "fingerprint"],
            )

    schema = T.StructType([*usable.schema.fields[:2], T.StructField("fingerprint", T.LongType())])
    return usable.mapInArrow(sign, schema)


def fingerprint_classes(signed: DataFrame) -> DataFrame:
    """Documents with one fingerprint as a single row: smallest ``id`` and ``copies``."""
    grouped = signed.groupBy("scope", "fingerprint").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    return materialize(grouped, "fingerprint-classes")


def _masks(max_distance: int, agreeing: int) -> list[int]:
    """Bit masks of every choice of ``agreeing`` blocks out of ``max_distance + agreeing``."""
    blocks = max_distance + agreeing
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, agreeing)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_pairs(classes: DataFrame, max_distance: int = 3, agreeing: int = 3) -> DataFrame:
    """Fingerprint classes at most ``max_distance`` bits apart, each pair once.

    With ``max_distance`` differing bits, some ``agreeing`` of
    ``max_distance + agreeing`` blocks are equal, so all pairs meet on a mask;
    the default keys hold about 32 bits and stay selective for billions of
    rows. A pair is kept only on the first mask it agrees on, hence no distinct.
    """
    masks = [_signed(m) for m in _masks(max_distance, agreeing)]
    fingerprint = F.col("fingerprint")
    keys = F.array(*[fingerprint.bitwiseAND(F.lit(m)) for m in masks])
    rows = classes.select("scope", "id", "fingerprint", F.posexplode(keys).alias("mask", "key"))
    differing = F.col("a_fingerprint").bitwiseXOR(F.col("b_fingerprint"))
    first: Column = F.lit(-1)
    for i in reversed(range(len(masks))):
        first = F.when(differing.bitwiseAND(F.lit(masks[i])) == 0, i).otherwise(first)
    return (
        bucket_pairs(rows, ["scope", "mask", "key"], "id")
        .where((F.bit_count(differing) <= max_distance) & (F.col("mask") == first))
        .select(
            "scope", F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"),
            F.bit_count(differing).alias("distance"),
        )
    )


def claimed_by_leaders(pairs: DataFrame) -> DataFrame:
    """Leader of every claimed id: ``scope, id, leader``.

    Ids are visited in order; one not yet claimed leads and claims its unclaimed
    neighbours. That outcome does not need the visit: an id with no undecided
    smaller neighbour leads, its neighbours are claimed, and what remains is
    decided in the next round. A claimed id belongs to its smallest leader.
    """
    edges = materialize(pairs.select("scope", "id_a", "id_b"), "near-edges")

    def without(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return rows.join(ids.withColumnRenamed("id", column), ["scope", column], "left_anti")

    claimed = edges.select("scope", F.col("id_b").alias("id")).limit(0)
    undecided = edges
    while not undecided.isEmpty():
        larger = undecided.select("scope", F.col("id_b").alias("id")).distinct()
        newly = materialize(
            without(undecided, "id_a", larger).select("scope", F.col("id_b").alias("id")).distinct(),
            "claimed",
        )
        claimed = claimed.unionByName(newly)
        undecided = materialize(
            without(without(undecided, "id_a", newly), "id_b", newly), "undecided-edges"
        )
    return without(edges, "id_a", claimed).groupBy("scope", F.col("id_b").alias("id")).agg(
        F.min("id_a").alias("leader")
    )


@dataclass(frozen=True)
class Groups:
    """``members(scope,leader,id)``: every duplicate and the document that leads its group."""

    signed: DataFrame
    members: DataFrame
    max_distance: int

    def stats(self) -> DataFrame:
        """Counts per scope, with the parameter echoed."""
        counts = self.signed.select(
            "scope", F.lit(1).alias("files"), F.lit(0).alias("found")
        ).unionByName(
            self.members.select("scope", "leader").distinct().select(
                "scope", F.lit(0).alias("files"), F.lit(1).alias("found")
            )
        )
        return counts.groupBy("scope").agg(
            F.sum("files").alias("files_analyzed"), F.sum("found").alias("duplicate_groups_found"),
            F.lit(self.max_distance).alias("hamming_distance_k"),
        )


def duplicate_groups(docs: DataFrame, max_distance: int = 3) -> Groups:
    """Leader groups of near-duplicates among ``scope, id, text`` rows.

    Groups are formed among distinct fingerprints; further copies of a
    fingerprint then follow the leader of its class, or the class itself.
    """
    signed = materialize(fingerprints(docs), "fingerprints")
    classes = fingerprint_classes(signed)
    claims = claimed_by_leaders(near_pairs(classes, max_distance))
    led = (
        classes.join(claims, ["scope", "id"], "left")
        .where((F.col("copies") > 1) | F.col("leader").isNotNull())
        .select("scope", "fingerprint", F.coalesce("leader", "id").alias("leader"))
    )
    members = signed.join(led, ["scope", "fingerprint"]).where(
        F.col("id") != F.col("leader")
    ).select("scope", "leader", "id")
    return Groups(signed, materialize(members, "group-members"), max_distance)
