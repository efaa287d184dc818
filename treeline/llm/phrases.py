"""Collocations: phrases whose words occur together more often than apart.

Words get ids by falling frequency, so a pair of ids is a place in a square that
is dense near its origin. The square is cut into tiles of ``SIDE`` ids a side. Tiles
near the origin are counted by direct address (``np.bincount`` over the cells);
the others as sorted coordinates with counts, in bands of rows that widen as ids
grow rare. Frequent pairs are ranked by frequency again and take the place of words:
two neighbouring pairs are a phrase of three words, and so on. There may be up to
2^31 phrases of a length.

Texts move as chunks of some ``CHUNK`` words of one language. A chunk knows its
distinct words, and later its distinct cells, and gets ids for those only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from treeline.llm.ranks import numbered
from treeline.llm.store import discard, stored
from treeline.llm.words import LOWER, text_buffers

CHUNK = 1 << 19  # words
SIDE_BITS = 10
SIDE = 1 << SIDE_BITS
_DENSE = 64  # tile (i, j) is counted by direct address if (i + 1) * (j + 1) is at most this
_FAN = 128  # partial counts of a tile that one merge reads
_HELD = 1 << 21  # coordinates that a merge holds before it adds them up
_GROUP = 1 << 20  # bytes of text split at once
_SPARSE = np.int64(1 << 62)
_BANDED = 64  # rows of tiles with a band each; from there on an octave of rows has 16 bands
_SHARED = 4096  # chunks for which a band stays whole; with more it is dealt out by the right id

_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK

_CHUNKS = "chunk long, lang string, own int, seq binary, words array<string>, counts array<long>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of the texts, and which of them begin a piece."""
    low = LOWER[data]
    kind = _KIND[low]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = kind == _WORD
    first = inside[1:-1] & ~inside[:-2]
    bounds = offsets[:-1][offsets[:-1] < len(low)]
    first[bounds] = inside[1:-1][bounds]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, bool)
    # a piece ends at a break and at the end of a text
    broken = np.cumsum(kind == _BREAK, dtype=np.int64)[starts] + np.searchsorted(offsets, starts, "right")
    begins = np.ones(len(starts), bool)
    begins[1:] = broken[1:] != broken[:-1]
    letters = low[inside[1:-1]]
    ends = np.append(np.cumsum(inside[1:-1], dtype=np.int64)[starts] - 1, len(letters))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters))
    return words, begins


def _chunk_rows(
    lang: str, words: list[pa.DictionaryArray], begins: list[np.ndarray], reach: int, places: int
) -> Iterator[tuple]:
    """Own length, ids, words and counts of chunks; ids are local, -1 stands between pieces.

    What has more than ``places`` is cut anywhere; each part also holds the next
    ``reach`` places, which belong to the following one.
    """
    coded = pa.chunked_array(words).unify_dictionaries()
    names = coded.chunk(0).dictionary
    ids = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    gaps = np.concatenate(begins)
    seq = np.full(len(ids) + int(gaps.sum()), -1, np.int32)
    seq[np.arange(len(ids)) + np.cumsum(gaps)] = ids
    for start in range(0, len(seq), places):
        part = seq[start : start + places + reach]
        own = min(len(part), places)
        used, local = np.unique(part, return_inverse=True)
        counts = np.bincount(local[:own], minlength=len(used))
        apart = int(used[0] == -1)
        here = names.take(pa.array(used[apart:])).cast(pa.string())
        yield lang, own, (local - apart).astype(np.int32).tobytes(), here, counts[apart:]


def _chunks(docs: DataFrame, reach: int, chunk_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_words: dict[str, list[pa.DictionaryArray]] = {}
        open_begins: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 33

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            del sizes[lang]
            parts = _chunk_rows(lang, open_words.pop(lang), open_begins.pop(lang), reach, 2 * chunk_words)
            for lang, own, seq, names, counts in parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([own], pa.int32()),
                    pa.array([seq], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())),
                ], ["chunk", "lang", "own", "seq", "words", "counts"])
                number += 1

        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in dict.fromkeys(langs):
                texts = batch.column("text").filter(pa.array(langs == lang))
                for _, data, offsets in text_buffers(texts, _GROUP):
                    words, begins = _words(data, offsets)
                    if not len(words):
                        continue
                    open_words.setdefault(lang, []).append(words.dictionary_encode())
                    open_begins.setdefault(lang, []).append(begins)
                    sizes[lang] = sizes.get(lang, 0) + len(words)
                    if sizes[lang] >= chunk_words:
                        yield from flush(lang)
                    while sum(sizes.values()) >= 2 * chunk_words:
                        yield from flush(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from flush(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _CHUNKS)


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, their low halves first: the high ones are mostly zeros and compress to nothing."""
    return numbers.astype(np.int64).view(np.uint32).reshape(-1, 2).T.tobytes()


def _longs(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint32).reshape(2, -1).T).view(np.int64).ravel()


def _ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32)


def _address(left: np.ndarray, right: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Tile, or part of a band of sparse tiles, and cell of each pair of ids."""
    i, j = left >> SIDE_BITS, right >> SIDE_BITS
    dense = (i + 1) * (j + 1) <= _DENSE
    octave = np.frexp(np.maximum(i, _BANDED))[1].astype(np.int64) - 1
    band = np.where(i < _BANDED, i, _BANDED + 16 * (octave - 6) + ((i >> (octave - 4)) & 15))
    tile = np.where(dense, i << 31 | j, _SPARSE | band << 31 | right % parts)
    cell = np.where(dense, (left & (SIDE - 1)) << SIDE_BITS | right & (SIDE - 1), left << 32 | right)
    return tile, cell


def _ids(tile: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids that ``_address`` has put there."""
    if tile & int(_SPARSE):
        return cells >> 32, cells & ((1 << 32) - 1)
    return (tile >> 31 << SIDE_BITS) + (cells >> SIDE_BITS), ((tile & (1 << 31) - 1) << SIDE_BITS) + (cells & (SIDE - 1))


def _counted(tile: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts; a well-filled tile by direct address."""
    if not tile & int(_SPARSE) and len(cells) >= SIDE * SIDE // 16:
        counts = np.bincount(cells, minlength=SIDE * SIDE)
        used = np.flatnonzero(counts)
        return used, counts[used]
    return np.unique(cells, return_counts=True)


def _summed(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates with the counts of equal ones added."""
    joined = np.concatenate(cells)
    order = np.argsort(joined, kind="stable")
    joined = joined[order]
    first = np.flatnonzero(np.diff(joined, prepend=-1))
    return joined[first], np.add.reduceat(np.concatenate(counts)[order], first)


_PARTIAL = "tile long, chunk long, cells binary, counts binary"


def _partial_rows(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
        pa.array([_packed(r[2]) for r in rows], pa.binary()),
        pa.array([_packed(r[3]) for r in rows], pa.binary()),
    ], ["tile", "chunk", "cells", "counts"])


def _tile_counts(sequences: DataFrame, parts: int) -> DataFrame:
    """Counts of neighbouring ids, chunk by chunk and tile by tile."""
    def rows(chunk: int, own: int, seq: np.ndarray) -> Iterator[tuple]:
        for start, end, counts_here in ((0, own, 1), (own, len(seq), 0)):
            left, right = seq[start : min(end, len(seq) - 1)], seq[start + 1 : end + 1]
            both = (left >= 0) & (right >= 0)
            tiles, cells = _address(left[both], right[both], parts)
            order = np.argsort(tiles, kind="stable")
            tiles, cells = tiles[order], cells[order]
            bounds = np.append(np.flatnonzero(np.diff(tiles, prepend=-1)), len(tiles))
            for a, b in zip(bounds[:-1], bounds[1:]):
                used, counts = _counted(int(tiles[a]), cells[a:b])
                yield int(tiles[a]), chunk, used, counts * counts_here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, seq in zip(*(batch.column(c) for c in ("chunk", "own", "seq"))):
                ready, size = [], 0
                for row in rows(chunk.as_py(), own.as_py(), _longs(seq.as_py())):
                    ready.append(row)
                    size += len(row[2])
                    if size >= _HELD // 4:
                        yield _partial_rows(ready)
                        ready, size = [], 0
                if ready:
                    yield _partial_rows(ready)

    return sequences.select("chunk", "own", "seq").mapInArrow(run, _PARTIAL)


def _merged(partials: DataFrame, salts: int) -> DataFrame:
    """Partial counts of a tile added up within each salt, which takes the place of ``chunk``.

    Rows come sorted, so a task holds the counts of one tile at a time.
    """
    def merge(tile: int, salt: int, cells: list, counts: list) -> tuple:
        if tile & int(_SPARSE):
            return tile, salt, *_summed(cells, counts)
        table = np.zeros(SIDE * SIDE, np.int64)
        for at, n in zip(cells, counts):
            table[at] += n
        used = np.flatnonzero(table)
        return tile, salt, used, table[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cells, counts, held = None, [], [], 0
        for batch in batches:
            for tile, salt, at, n in zip(*(batch.column(c) for c in ("tile", "chunk", "cells", "counts"))):
                key = tile.as_py(), salt.as_py()
                if key != current and cells:
                    yield _partial_rows([merge(*current, cells, counts)])
                    cells, counts, held = [], [], 0
                current = key
                cells.append(_longs(at.as_py()))
                counts.append(_longs(n.as_py()))
                held += len(cells[-1])
                if held >= _HELD:
                    _, _, at, n = merge(*current, cells, counts)
                    cells, counts, held = [at], [n], 0
        if cells:
            yield _partial_rows([merge(*current, cells, counts)])

    salted = partials.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("long"))
    return salted.repartition("tile", "chunk").sortWithinPartitions("tile", "chunk").mapInArrow(run, _PARTIAL)


def _frequent(partials: DataFrame, chunks: int, least: int) -> DataFrame:
    """``left, right, tile, cell, n`` of pairs with ``n`` of at least ``least``."""
    while chunks > _FAN:
        chunks = -(-chunks // _FAN)
        partials = _merged(partials, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, at, n in zip(*(batch.column(c) for c in ("tile", "cells", "counts"))):
                cells, counts = _longs(at.as_py()), _longs(n.as_py())
                kept = counts >= least
                cells, counts = cells[kept], counts[kept]
                left, right = _ids(tile.as_py(), cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left), pa.array(right), pa.array(np.full(len(cells), tile.as_py())), pa.array(cells), pa.array(counts)],
                    ["left", "right", "tile", "cell", "n"],
                )

    merged = _merged(partials, 1)
    return merged.select("tile", "cells", "counts").mapInArrow(run, "left long, right long, tile long, cell long, n long")


_LABEL_TYPES = pa.int64(), pa.int64(), pa.binary(), pa.binary()


def _cell_ids(partials: DataFrame, ranked: DataFrame, chunks: int) -> DataFrame:
    """``chunk, tile, cells, ids``: the frequent ones of a chunk's cells with their ids.

    The ids of a tile meet its chunks in one task, or in several that each hold
    the table of the tile: a chunk in ``_FAN`` goes to the same one.
    """
    def salts(tile: str) -> Column:
        sparse = F.col(tile) >= F.lit(int(_SPARSE))
        return F.when(sparse, -(-chunks // (64 * _FAN))).otherwise(-(-chunks // _FAN)).cast("long")

    every = F.explode(F.sequence(F.lit(0).cast("long"), salts("tile") - 1))
    table = ranked.select("tile", every.alias("salt"), F.lit(None).cast("long").alias("chunk"), "cell", "id", F.lit(None).cast("binary").alias("cells"))
    asked = partials.select(
        "tile", F.pmod(F.xxhash64("chunk"), salts("tile")).alias("salt"), "chunk",
        F.lit(None).cast("long").alias("cell"), F.lit(None).cast("long").alias("id"), "cells",
    )
    together = table.unionByName(asked).repartition("tile", "salt").sortWithinPartitions("tile", "salt", F.asc_nulls_first("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, ready = None, [], None

        def lookup(tile: int, cells: np.ndarray) -> np.ndarray:
            nonlocal ready
            if ready is None:
                at = np.concatenate([k[0] for k in known]) if known else np.zeros(0, np.int64)
                ids = np.concatenate([k[1] for k in known]) if known else np.zeros(0, np.int64)
                if tile & int(_SPARSE):
                    order = np.argsort(at)
                    ready = at[order], ids[order]
                else:
                    ready = np.full(SIDE * SIDE, -1, np.int64)
                    ready[at] = ids
            if isinstance(ready, np.ndarray):
                return ready[cells]
            at, ids = ready
            if not len(at):
                return np.full(len(cells), -1, np.int64)
            place = np.minimum(np.searchsorted(at, cells), len(at) - 1)
            return np.where(at[place] == cells, ids[place], -1)

        for batch in batches:
            tiles, salted = batch.column("tile").to_numpy(), batch.column("salt").to_numpy()
            asks = ~np.asarray(batch.column("chunk").is_null())
            changes = (np.diff(tiles) != 0) | (np.diff(salted) != 0) | asks[1:] | (np.diff(asks.view(np.int8)) != 0)
            bounds = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(tiles)]])
            found = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if (tiles[a], salted[a]) != current:
                    current, known, ready = (tiles[a], salted[a]), [], None
                if not asks[a]:
                    known.append((
                        batch.column("cell").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64),
                        batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64),
                    ))
                    continue
                cells = _longs(batch.column("cells")[int(a)].as_py())
                ids = lookup(int(tiles[a]), cells)
                known_here = ids >= 0
                if known_here.any():
                    chunk = batch.column("chunk")[int(a)].as_py()
                    found.append((chunk, int(tiles[a]), _packed(cells[known_here]), _packed(ids[known_here])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _LABEL_TYPES)], ["chunk", "tile", "cells", "ids"])

    return together.select("tile", "salt", "chunk", "cell", "id", "cells").mapInArrow(run, "chunk long, tile long, cells binary, ids binary")


_SEQUENCES = "chunk long, own int, seq binary"


def _sequence_rows(chunk: int, own: int, seq: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), pa.array([_packed(seq)], pa.binary())],
        ["chunk", "own", "seq"],
    )


def _word_ids(chunks: DataFrame, entries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The chunks with global ids; rare words have none and part the others like a break."""
    known = entries.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(F.struct("local", "id")).alias("known")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, seq, size, pairs in zip(*(batch.column(c) for c in ("chunk", "own", "seq", "size", "known"))):
                ids = np.full(size.as_py() + 1, -1, np.int64)
                ids[pairs.values.field("local").to_numpy()] = pairs.values.field("id").to_numpy()
                yield _sequence_rows(chunk.as_py(), own.as_py(), ids[_ints(seq.as_py())])

    joined = chunks.select("chunk", "own", "seq", F.size("words").alias("size")).join(known, "chunk")
    return joined.mapInArrow(run, _SEQUENCES)


def _phrase_ids(sequences: DataFrame, labels: DataFrame) -> DataFrame:
    """The chunks with the id of the phrase that begins at each place."""
    known = labels.groupBy("chunk").agg(F.collect_list(F.struct("tile", "cells", "ids")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own, seq, parts in zip(*(batch.column(c) for c in ("chunk", "own", "seq", "known"))):
                seq = _longs(seq.as_py())
                parts = [parts.values.field(c) for c in ("tile", "cells", "ids")]
                places = [_ids(tile.as_py(), _longs(cells.as_py())) for tile, cells in zip(*parts[:2])]
                left, right = (np.concatenate(side) for side in zip(*places))
                ids = np.concatenate([_longs(i.as_py()) for i in parts[2]])
                # ids of the chunk as small numbers, so that a pair is one number
                lefts, rights = np.unique(left), np.unique(right)
                place = [np.minimum(np.searchsorted(have, x), len(have) - 1) for have, x in ((lefts, seq[:-1]), (rights, seq[1:]))]
                code = place[0] * len(rights) + place[1]
                valid = (lefts[place[0]] == seq[:-1]) & (rights[place[1]] == seq[1:])
                have = np.searchsorted(lefts, left) * len(rights) + np.searchsorted(rights, right)
                order = np.argsort(have)
                at = np.minimum(np.searchsorted(have, code, sorter=order), len(have) - 1)
                valid &= have[order[at]] == code
                yield _sequence_rows(chunk.as_py(), own.as_py(), np.append(np.where(valid, ids[order[at]], -1), -1))

    return sequences.join(known, "chunk").mapInArrow(run, _SEQUENCES)


def frequent_phrases(
    docs: DataFrame, max_words: int = 3, least: int = 10, chunk_words: int = CHUNK
) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n_words`` of every language, and a table for each length from one word.

    A table has ``id, left, right, n, lang, words, prefixes, suffixes``: how often the
    phrase occurs, the ids of its parts without the last and without the first
    word, and the counts of its first and last 1, 2, ... words.
    """
    chunks = stored(_chunks(docs, max_words - 1, chunk_words), "phrase-chunks")
    n_chunks = chunks.count()
    entries = chunks.select("chunk", "lang", "counts", F.posexplode("words").alias("local", "word")).select(
        "chunk", "lang", "local", "word", F.col("counts")[F.col("local")].alias("n")
    )
    counts = stored(entries.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n_words"))
    vocabulary = stored(
        numbered(counts.where(F.col("n") >= least), "word-ranks", "id", F.desc("n"), F.col("lang"), F.col("word")), "vocabulary"
    )
    none = F.lit(None).cast("long")
    tables = [vocabulary.select(
        "id", none.alias("left"), none.alias("right"), "n", "lang", F.array("word").alias("words"),
        F.array("n").alias("prefixes"), F.array("n").alias("suffixes"),
    )]
    sequences = stored(_word_ids(chunks, entries, vocabulary), "word-ids") if max_words > 1 else None
    discard(chunks)
    for length in range(2, max_words + 1):
        partials = stored(_tile_counts(sequences, n_chunks // _SHARED + 1), f"tiles-{length}")
        frequent = stored(_frequent(partials, n_chunks, least), f"frequent-{length}")
        ranked = stored(numbered(frequent, f"ranks-{length}", "id", F.desc("n"), F.col("left"), F.col("right")), f"ranked-{length}")
        shorter = tables[-1]
        heads = shorter.select(F.col("id").alias("left"), "lang", F.col("words").alias("head"), F.col("prefixes").alias("before"))
        tails = shorter.select(F.col("id").alias("right"), F.element_at("words", -1).alias("tail"), F.col("suffixes").alias("behind"))
        tables.append(stored(ranked.join(heads, "left").join(tails, "right").select(
            "id", "left", "right", "n", "lang", F.concat("head", F.array("tail")).alias("words"),
            F.concat("before", F.array("n")).alias("prefixes"), F.concat("behind", F.array("n")).alias("suffixes"),
        ), f"phrases-{length}"))
        done = [partials, sequences, frequent]
        if length < max_words:
            sequences = stored(_phrase_ids(sequences, _cell_ids(partials, ranked, n_chunks)), f"phrase-ids-{length}")
        for read in done:
            discard(read)
    return totals, tables


# the lowest of all cuts; ties go to the shorter first part. Decimals hold products beyond 64 bits.
_CUT = """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
  'score', cast(cast(1000000 as decimal(7, 0)) * (cast(n as decimal(18, 0)) * cast(n as decimal(18, 0)))
    div (cast(prefixes[k - 1] as decimal(18, 0)) * cast(suffixes[size(words) - k - 1] as decimal(18, 0))) as bigint),
  'k', k, 'l', prefixes[k - 1], 'r', suffixes[size(words) - k - 1])))"""
_BLOCK = 1 << 14


def collocations(
    docs: DataFrame, max_words: int = 3, least: int = 10, top: int = 2000, chunk_words: int = CHUNK
) -> DataFrame:
    """The best ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase has 2 to ``max_words`` words of one piece (texts are split at ``.,;:!?``
    and line ends), A-Z lower-cased, and occurs ``a`` times, at least ``least``. Its
    score is floor(10^6 a^2 / (l r)) at the cut with the lowest, l and r being the
    counts of the parts; ``n`` counts the words of the language. A phrase within a
    longer one that occurs at least half as often is left out. Ties rank by
    higher ``a``, then by the phrase's bytes.

    Null and empty texts hold no words, a null language reads ``und``. Repeated rows
    count each time. Other columns are not read. No rows give no rows.
    """
    totals, tables = frequent_phrases(docs, max_words, least, chunk_words)
    found = None
    for length, phrases in enumerate(tables[1:], 2):
        if length < max_words:
            longer = tables[length]
            within = longer.select(F.col("left").alias("id"), "n").unionByName(longer.select(F.col("right").alias("id"), "n"))
            longest = within.groupBy("id").agg(F.max("n").alias("_longer"))
            phrases = phrases.join(longest, "id", "left").where(
                F.col("_longer").isNull() | (100 * F.col("_longer") < 50 * F.col("n"))
            )
        kept = phrases.select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"), F.expr(_CUT).alias("cut"))
        found = kept if found is None else found.unionByName(kept)
    scored = stored(found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "collocations")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # blocks of a language rank on their own first, so that no task sorts a whole language
    blocks = scored.count() // _BLOCK + 1
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
    for groups in ([F.col("lang"), block], [F.col("lang")]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*best))).where(F.col("rank") <= top)
    return scored.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score"
    )
