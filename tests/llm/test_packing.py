import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from treeline.llm import packing
from treeline.llm.words import text_buffers

SCHEMA = "doc_id long, text string, piece int, ids int, task string, length long"
PLAIN = Tokenizer.from_file(packing.TOKENIZER)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every packing."""
    lengths = sorted(lengths, reverse=True)

    @lru_cache(None)
    def pack(at, rooms):
        if at == len(lengths):
            return len(rooms)
        best = pack(at + 1, tuple(sorted((*rooms, capacity - lengths[at]))))
        for i, room in enumerate(rooms):
            if room >= lengths[at] and room not in rooms[:i]:
                best = min(best, pack(at + 1, tuple(sorted((*rooms[:i], room - lengths[at], *rooms[i + 1 :])))))
        return best

    return pack(0, ())


def histogram(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


@pytest.mark.parametrize("seed", range(40))
def test_search_is_optimal_on_small_cases(seed):
    pick = random.Random(seed)
    capacity = pick.choice([12, 30, 100])
    lengths = [pick.randint(1, capacity) if seed % 2 else pick.randint(capacity // 5, capacity // 2 + 2) for _ in range(pick.randint(0, 9))]
    counts = histogram(lengths, capacity)
    found = packing.bin_completion(counts)
    packed = np.zeros(capacity + 1, int)
    for times, filling in found:
        assert sum(n * c for n, c in filling) <= capacity
        for n, c in filling:
            packed[n] += times * c
    assert (packed == counts).all()
    best = fewest(lengths, capacity)
    assert sum(t for t, _ in found) == best >= packing.least_sequences(counts)


def test_search_beats_best_fit():
    """Best fit decreasing takes one more than the four sequences of 3 + 3 + 4 and 2 + 2 + 6."""
    counts = histogram([6, 6, 4, 4, 3, 3, 3, 3, 2, 2, 2, 2], 10)
    assert sum(t for t, _ in packing.best_fit_decreasing(counts)) == 5
    assert sum(t for t, _ in packing.bin_completion(counts)) == 4


def test_many_pieces_stay_near_the_bound_with_a_short_plan():
    pick = np.random.default_rng(1)
    lengths = np.concatenate([pick.integers(1, 2048, 300_000), np.full(150_000, 256)])
    counts = histogram(lengths, 2048) * 10_000
    found = packing.bin_completion(counts, nodes=50)
    assert sum(t for t, _ in found) <= packing.least_sequences(counts) * 1.001
    assert len(found) < 20_000


def test_domination():
    assert packing._dominates([5, 3], [3, 2, 3]) and packing._dominates([4], [2, 2])
    assert not packing._dominates([5, 3], [4, 4]) and not packing._dominates([3, 3], [5])


def test_words_equal_whole_texts():
    odd = [
        "", "  ", "é ß 中文 😀 ▁ \x00 end", "a<|endoftext|>b I'LL don't’s x,'s y.'s z!s", "é ́x a b c\x85d\x1cq", "ΑΣ ΣΑΣ. İI",
        "x" * 3000, " 　x", ",́ a,b.c!?;:'t 1.2,3 .a", "a" + "́,", "<|startoftext|>,", "x<|endoftext|>1#a'll-'s_'t 12'd3'm#'re", "a<|endoftext|", "naïve.Café:Ünï",
    ]
    pick = random.Random(3)
    odd += ["".join(pick.choice("aB19 .,;:!?'s\té́中\n-_<|>#\"²½") for _ in range(pick.randint(0, 60))) for _ in range(400)]
    words, got = packing._words(open(packing.TOKENIZER).read()), []
    for _, data, offsets in text_buffers(pa.array(odd), limit=500):
        ids, bounds = words.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids + [packing.END] for t in odd]


def test_forgotten_words_come_back(monkeypatch):
    monkeypatch.setattr(packing, "_KNOWN", 5)
    words = packing._Words(open(packing.TOKENIZER).read())
    for text in ("one two three four", "five six one", "one two"):
        _, data, offsets = next(iter(text_buffers(pa.array([text]))))
        assert words.encode(data, offsets)[0].tolist() == PLAIN.encode(text, add_special_tokens=False).ids + [packing.END]


def test_documents_come_back_from_their_sequences(spark, prose):
    """Odd rows, a text of many pieces and a third of the rows alike; whole ids, gapless offsets."""
    rows = [r[:2] for r in ODD] + [(10, prose(3000, 10))] + [(20 + i, prose(i * 7, i)) for i in range(40)]
    rows += [(100 + i, "the same few words") for i in range(30)]
    docs = spark.createDataFrame([(*r, 0, 1, "t", 2) for r in rows], SCHEMA).repartition(5)
    packed = packing.pack(docs, capacity=64).collect()
    by_sequence, by_piece = {}, {}
    for r in packed:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 64 and r.start == 64 * r.piece
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, ids))
        by_piece.setdefault(r.doc_id, []).append((r.piece, tuple(ids)))
    for parts in by_sequence.values():
        at = 0
        for offset, ids in sorted(parts):
            assert offset == at
            at += len(ids)
        assert at <= 64
    plain = {}
    for doc_id, text in rows:
        ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [packing.END]
        plain.setdefault(doc_id, []).extend((i // 64, tuple(ids[i : i + 64])) for i in range(0, len(ids), 64))
    assert {k: sorted(v) for k, v in by_piece.items()} == {k: sorted(v) for k, v in plain.items()}
    counts = histogram([r.length for r in packed], 64)
    assert len(by_sequence) <= packing.least_sequences(counts) + 1
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(spark.createDataFrame(packed)).collect()}
    assert whole == {k: [i for _, ids in sorted(v) for i in ids] for k, v in by_sequence.items()}


def test_query(spark, tmp_path, prose):
    from treeline.llm.queries import QUERIES

    rows = [(i, prose(i * 50, i), "en", "s", 1) for i in range(100)] + [(200, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op12_best_fit_packing"](spark, str(tmp_path))
    assert dict(found.dtypes).items() >= {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "offset": "int"
    }.items()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.collect()}
    for doc_id, text, *_ in rows:
        ids = np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            assert got.pop((doc_id, p)) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not got


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).collect() == [] and packing.sequences(packing.pack(empty)).where(F.lit(True)).collect() == []
