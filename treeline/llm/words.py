"""Words of UTF-8 texts as numpy arrays, read straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_PIECE = 1 << 19  # bytes hashed at once: bounds the temporary arrays
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND = np.random.default_rng(20_012).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    first: np.ndarray  # word number where each text begins, and the total
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray  # 64 bits


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, _PIECE + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Sums of byte values times powers; a span's hash is a difference, shifted back to power 0."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    shifted = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mixed(shifted + (ends - starts).astype(np.uint64) * _MIX[1])


def text_buffers(column: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of groups of texts of about ``limit`` bytes; null reads as empty."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _digests(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BLAKE2 hashes of words that stand one behind the other; each distinct word is hashed once."""
    bounds = np.append(0, ends)
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
    ).dictionary_encode()
    hashes = b"".join([blake2b(w, digest_size=8).digest() for w in coded.dictionary.to_pylist()])
    return np.frombuffer(hashes, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, strong: bool = False) -> Words:
    """Words of the texts, A-Z lower-cased; ``is_word`` tells by lower-cased byte.

    Hashes are sums of powers, which differ in places only and collide for some built
    words; ``strong`` ones come from the words' bytes as a whole.
    """
    low = LOWER[data]
    inside = is_word[low]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    if strong:
        return Words(np.searchsorted(starts, offsets), starts, ends, _digests(low[inside], np.cumsum(ends - starts)))
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + _PIECE, "right")))
        begin, end = starts[done], ends[upto - 1]
        hashes[done:upto] = span_hashes(
            prefix_hashes(low[begin:end]), starts[done:upto] - begin, ends[done:upto] - begin
        )
        done = upto
    return Words(np.searchsorted(starts, offsets), starts, ends, hashes)
