"""Packing of tokenised documents into few sequences of fixed size.

The packing only depends on how many pieces there are of each length, and those
are at most ``capacity`` numbers whatever the corpus holds. So the search runs over
that histogram in one task, and its answer says how many sequences get which
lengths. A sequence is filled as in bin completion: its largest piece is given, the
fillings of what is left are listed without those that another one dominates, and
each is used as often as the counts allow. Depth first, least waste first; a branch
goes when a bound on the waste to come shows that it cannot beat the incumbent.
The first incumbent is the best-fit decreasing packing.

Pieces find their place by number: the how-manieth of its length a piece is follows
from counts per task, and every length has a list of intervals of such numbers. A
filling used m times leaves fewer than c pieces of a length it holds c times, so
there are at most capacity * ln(capacity) fillings or so: the list is small at any
size of the corpus, and the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from treeline.llm.store import stored
from treeline.llm.words import text_buffers

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END = 0  # id behind every document

_GROUP = 1 << 22  # bytes of text tokenised at once
_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_KNOWN = 1 << 19  # words whose ids a worker remembers
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# ASCII letters, digits, and signs that are in no special token and begin no contraction
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[[*range(48, 58)]] = _DIGIT
_CLASS[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = _SIGN

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


class _Words:
    """Ids of texts, word by word.

    The tokenizer never joins over a blank, a digit with anything, or a letter with
    a sign; so a text's ids are those of its parts between such places.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has.

        A word of Latin letters is one word to the tokenizer and its last token says
        so; such words are encoded as one text. Others go one by one.
        """
        plain = pc.match_substring_regex(words, _LATIN).to_numpy(zero_copy_only=False)
        flat, sizes = [], np.zeros(len(words), np.int64)
        if plain.any():
            text = " ".join(words.filter(pa.array(plain)).to_pylist())
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) == plain.sum():
                sizes[plain] = np.diff(ends, prepend=-1)
                flat.append(ids)
            else:
                plain[:] = False
        others = words.filter(pa.array(~plain)).to_pylist()
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        sizes[~plain] = [len(ids) for ids in encoded]
        flat.append(np.fromiter(chain.from_iterable(encoded), np.uint32))
        # back to the order of the words: first the plain ones lie there, then the others
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begins = np.empty(len(words), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.concatenate(flat)[at], sizes

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, under which its ids are remembered; new ones are learned."""
        if len(self.numbers) + len(words) > _KNOWN:
            self._forget()
        texts = words.to_pylist()
        numbers = np.fromiter(map(self.numbers.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            ids, sizes = self._ids(words.take(pa.array(new)))
            numbers[new] = np.arange(len(self.numbers), len(self.numbers) + len(new))
            self.numbers.update((texts[i], n) for i, n in zip(new.tolist(), numbers[new].tolist()))
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``END`` behind each, and where each text begins."""
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~_BLANK[data]
        first = inside[:-1].copy()
        first[1:] &= ~inside[:-2]
        kind = _CLASS[data]
        first[1:] |= (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        first[bounds] = inside[bounds]
        starts = np.flatnonzero(first)
        letters = data[inside[:-1]]
        ends = np.append((np.cumsum(inside[:-1], dtype=np.int64) - 1)[starts], len(letters))
        coded = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(ends), pa.py_buffer(letters)
        ).dictionary_encode()
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        # every text's END is a word of one id behind its others
        text_ends = np.searchsorted(starts, offsets[1:])
        sizes = np.insert(sizes, text_ends, 1)
        begins = np.insert(self.starts[numbers], text_ends, -1)
        before = np.cumsum(sizes) - sizes
        at = np.repeat(begins - before, sizes) + np.arange(sizes.sum())
        is_end = before[begins == -1]
        at[is_end] = 0
        ids = self.flat[at] if len(self.flat) else np.zeros(len(at), np.uint32)
        ids[is_end] = END
        return ids, np.append(0, is_end + 1)


_workers: dict[str, _Words] = {}


def _words(model: str) -> _Words:
    """One per worker process, so that its memory serves all tasks there."""
    if model not in _workers:
        _workers[model] = _Words(model)
    return _workers[model]


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids, task, nth``, written as a table.

    ``ids`` are little-endian 32-bit numbers; ``nth`` numbers the pieces of one length within a task.
    """
    model = Path(tokenizer).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _words(model), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for row, data, offsets in text_buffers(batch.column("text"), _GROUP):
                ids, bounds = words.encode(data, offsets)
                lengths = np.diff(bounds)
                parts = -(-lengths // capacity)
                text = np.repeat(np.arange(len(lengths)), parts)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(lengths[text] - start, capacity)
                # number the pieces of each length from what the task has seen
                order = np.argsort(length, kind="stable")
                same = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                nth = np.empty(len(order), np.int64)
                nth[order] = seen[length[order]] + same
                seen += np.bincount(length, minlength=capacity + 1)
                data_ids = pa.BinaryArray.from_buffers(pa.large_binary(), len(text), [
                    None, pa.py_buffer(np.append(bounds[:-1][text] + start, bounds[-1]) * 4), pa.py_buffer(ids.astype("<u4")),
                ])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(text + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), data_ids.cast(pa.binary()), pa.array(np.full(len(text), task), pa.int32()), pa.array(nth),
                ], ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    source = documents.select("doc_id", "text")
    schema = StructType([source.schema["doc_id"]])
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("task", "integer"), ("nth", "long")):
        schema = schema.add(name, kind)
    return stored(source.mapInArrow(run, schema), "pieces")


def least_sequences(counts: np.ndarray) -> int:
    """Lower bound on the sequences for ``counts[length]`` pieces (Martello and Toth's L2).

    For every K, pieces over capacity - K and those over half need a sequence each, and
    the pieces from K to half go into what the latter leave, or need more.
    """
    capacity = len(counts) - 1
    half = capacity // 2
    lengths = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    k = np.arange(0, half + 1)
    alone = number[-1] - number[capacity - k]
    large, large_total = number[capacity - k] - number[half], total[capacity - k] - total[half]
    small_total = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small_total - (large * capacity - large_total)) // capacity))
    return int((alone + large + more).max())


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[int, Filling]]:
    """(times, filling): each length, longest first, goes to the fullest sequences that hold it."""
    capacity = len(counts) - 1
    room: list[dict[Filling, int]] = [{} for _ in range(capacity + 1)]
    room[capacity][()] = int(counts.sum())
    free = np.zeros(capacity + 1, bool)
    free[capacity] = True
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = length + int(np.argmax(free[length:]))
            filling, times = room[at].popitem()
            # a sequence stays the fullest while it holds another piece
            copies = min(at // length, left)
            used = min(times, left // copies)
            if times > used:
                room[at][filling] = times - used
            free[at] = bool(room[at])
            grown, at = (*filling, (length, copies)), at - length * copies
            room[at][grown] = room[at].get(grown, 0) + used
            free[at] = True
            left -= used * copies
    return [(times, filling) for at in room for filling, times in at.items() if filling]


def _dominates(a: list[int], b: list[int]) -> bool:
    """Can the lengths of ``b`` be dealt out so that they fit into those of ``a``, each into one?"""
    if not b:
        return True
    for i, room in enumerate(a):
        if b[0] <= room and room not in a[:i] and _dominates(sorted([*a[:i], room - b[0], *a[i + 1 :]], reverse=True), b[1:]):
            return True
    return False


def _exact(counts: np.ndarray, room: int, width: int) -> list[list[int]]:
    """Fillings of two or three pieces without waste, those with the longest pieces first, at most ``width``.

    Threes are looked for with up to 24 first lengths, spread over those there are.
    """
    present = np.flatnonzero(counts[:room])[::-1]
    present = present[present > 0]
    rest = room - present
    two = (rest <= present) & (rest > 0) & (counts[rest] > (rest == present))
    if two.any():
        return [[int(a), room - int(a)] for a in present[two][:width]]
    if not len(present):
        return []
    first = present[np.unique(np.linspace(0, len(present) - 1, 24).astype(int))][:, None]
    second = present[None, :]
    third = room - first - second
    fits = (second <= first) & (third > 0) & (third <= second)
    third = np.where(fits, third, 0)
    fits &= (counts[second] > (first == second)) & (counts[third] > (third == second).astype(int) + (third == first))
    found = []
    for i in np.flatnonzero(fits.any(1))[:width]:
        j = int(np.argmax(fits[i]))
        found.append([int(first[i, 0]), int(second[0, j]), int(third[i, j])])
    return found


def _greedy(counts: np.ndarray, room: int, width: int) -> list[list[int]]:
    """Undominated fillings, least waste first, at most ``width``.

    Two pieces are tried in all combinations of up to 16 lengths each, spread over
    the lengths there are; the rest goes to the largest that fit.
    """
    present = np.flatnonzero(counts[: room + 1])
    present = present[present > 0]
    below = np.zeros(room + 1, np.int64)
    below[present] = present
    below = np.maximum.accumulate(below)
    picks = present[np.unique(np.linspace(0, len(present) - 1, 16).astype(int))]
    one, two = np.meshgrid(picks[::-1], np.append(picks[::-1], 0), indexing="ij")
    fits = (two <= one) & (one + two <= room) & ((two < one) | (counts[one] > 1))
    chosen = [one[fits], two[fits]]
    rest = room - chosen[0] - chosen[1]
    last, run = chosen[0], np.zeros(len(rest), np.int64)  # the length taken last, and how often in a row
    while True:
        following = below[np.minimum(rest, last)]
        while True:
            used = np.where(following == last, run, 0) + (chosen[0] == following) + (chosen[1] == following)
            short = (following > 0) & (used >= counts[following])
            if not short.any():
                break
            following[short] = below[following[short] - 1]
        if not following.any():
            break
        chosen.append(following)
        rest = rest - following
        last, run = following, np.where(following == last, run, 0) + 1
    table = np.sort(np.stack(chosen, 1), axis=1)[:, ::-1]
    found: list[list[int]] = []
    for i in np.lexsort(((table > 0).sum(1), rest))[: 8 * width]:
        lengths = [int(x) for x in table[i] if x]
        if len(lengths) > 8:  # telling whether these are dominated takes too long
            if lengths not in found:
                found.append(lengths)
        elif not any(len(f) <= 8 and _dominates(f, lengths) for f in found):
            found.append(lengths)
        if len(found) == width:
            break
    return found


def _fillings(counts: np.ndarray, room: int, width: int) -> list[Filling]:
    """Ways to fill ``room`` from ``counts``: what every branch of the search tries, best first."""
    present = np.flatnonzero(counts[: room + 1])
    if not present.any():
        return [()]
    if present[-1] == room:
        return [((room, 1),)]  # every other filling fits into this piece
    found = _exact(counts, room, width) or _greedy(counts, room, width)
    return [tuple((n, f.count(n)) for n in dict.fromkeys(f)) for f in found]


def bin_completion(counts: np.ndarray, nodes: int = 4096, width: int = 4) -> list[tuple[int, Filling]]:
    """(times, filling) for ``counts[length]`` pieces, in as few sequences as the search finds.

    The search ends when it meets the lower bound or has opened ``nodes`` nodes beyond
    the first descent; that bounds its time, and the incumbent always packs every piece.
    """
    capacity = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    best = best_fit_decreasing(counts)
    fewest, bound = sum(t for t, _ in best), least_sequences(counts)
    path: list[tuple[int, Filling, list[Filling]]] = []
    used, opened, descending = 0, 0, True

    def apply(times: int, filling: Filling, sign: int) -> None:
        for length, copies in filling:
            counts[length] -= sign * times * copies

    def step(choices: list[Filling]) -> None:
        nonlocal used
        filling = choices.pop(0)
        times = int(min(counts[length] // copies for length, copies in filling))
        apply(times, filling, 1)
        used += times
        path.append((times, filling, choices))

    while fewest > bound and (descending or opened < nodes):
        opened += not descending
        left = np.flatnonzero(counts)
        choices = []
        if len(left) == 0:
            descending = False
            if used < fewest:
                fewest, best = used, [(t, f) for t, f, _ in path]
        elif descending or used + least_sequences(counts) < fewest:
            largest = int(left[-1])
            counts[largest] -= 1
            for filling in _fillings(counts, capacity - largest, width):
                copies = dict(filling)
                copies[largest] = copies.get(largest, 0) + 1
                choices.append(tuple(sorted(copies.items(), reverse=True)))
            counts[largest] += 1
        while not choices and path:
            times, filling, choices = path.pop()
            apply(times, filling, -1)
            used -= times
        if not choices:
            break
        step(choices)
    return best


_PLAN = "length long, first long, copies long, sequence long, at long"


def _plan(histogram: DataFrame, capacity: int, nodes: int) -> DataFrame:
    """Per length, intervals of piece numbers: ``copies`` in each sequence from ``sequence`` on, from place ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            counts[batch.column("length").to_numpy()] = batch.column("n").to_numpy()
        rows, sequence, first = [], 0, np.zeros(capacity + 1, np.int64)
        for times, filling in bin_completion(counts, nodes):
            at = 0
            for length, copies in filling:
                rows.append((length, first[length], copies, sequence, at))
                first[length] += times * copies
                at += length * copies
            sequence += times
        columns = np.array(rows, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "first", "copies", "sequence", "at"])

    return stored(histogram.coalesce(1).mapInArrow(run, _PLAN), "packing-plan")


def placed(cut: DataFrame, capacity: int = CAPACITY, nodes: int = 4096) -> DataFrame:
    """``cut (length, task, nth, ...)`` with ``sequence_id, offset``; ``task`` and ``nth`` go."""
    sizes = stored(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan = _plan(stored(sizes.groupBy("length").agg(F.sum("n").alias("n")), "histogram"), capacity, nodes)
    # bounded by the number of lengths, not by the corpus
    lengths, firsts, copies, sequences, ats = np.array(plan.sort("length", "first").collect(), np.int64).reshape(-1, 5).T
    shipped = cut.sparkSession.sparkContext.broadcast((lengths, firsts, copies, sequences, ats))

    @pandas_udf("sequence_id long, offset int")
    def place(length, number):
        import pandas as pd

        lengths, firsts, copies, sequences, ats = shipped.value
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        row = np.empty(len(length), np.int64)
        for one in np.unique(length):
            here = length == one
            a, b = starts[one], starts[one + 1]
            row[here] = a + np.searchsorted(firsts[a:b], number[here], "right") - 1
        within = number - firsts[row]
        return pd.DataFrame({
            "sequence_id": sequences[row] + within // copies[row],
            "offset": (ats[row] + within % copies[row] * length).astype(np.int32),
        })

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    joined = cut.join(before, ["task", "length"]).withColumn("_place", place("length", F.col("_before") + F.col("nth")))
    own = [c for c in cut.columns if c not in ("task", "nth")]
    return joined.select(*own, "_place.sequence_id", "_place.offset")


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of all documents.

    A document is the tokenizer's ids of its text and ``END``; only longer ones than
    ``capacity`` are cut. Null and empty texts are ``END`` alone. Ids may be null or
    repeated, each row is packed; other columns are not read. No rows give no rows.
    """
    return placed(pieces(documents, capacity, tokenizer), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the sequences themselves, ids as little-endian 32-bit numbers."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda joined, p: F.concat(joined, p["ids"])).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
