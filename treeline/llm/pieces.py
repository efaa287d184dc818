"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is encoded as ``▁`` plus the text with blanks as ``▁``; the pieces on the
best path maximise the sum of log scores. A character that no piece covers costs
the lowest score less 10 and falls back to one piece per UTF-8 byte. Of equal
paths the one found first from the left stays. Decoding joins pieces and bytes,
turns ``▁`` into blanks and drops the first. A ``▁`` of the text itself goes out
as bytes, so decoding an encoded text gives exactly that text.

Vocabularies are read from a model file on the driver and travel with the task.
Where the file holds merge ranks instead of log probabilities (scores falling in
whole steps), a piece of rank r gets log(1 / ((r + 1) H)), Zipf's law.

No piece goes on from another character to ``▁`` and none holds a newline, which
is checked on loading; so the best path is found stretch by stretch and short
stretches are remembered, up to ``_MEMORY`` of them per worker.

Null texts have null ids and no tokens, empty texts an empty list. Extra columns
come back as they were.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_OWN_SPACE = "\ud800"  # stands for a SPACE of the text; no valid text holds it
_UNKNOWN_COST = 10.0
_MEMORY, _SHORT = 200_000, 48
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


@dataclass
class Vocabulary:
    """Pieces by id, their log scores (None: never matched), and the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: list[float | None]
    bytes_ids: list[int]
    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)
    codes: dict[str, int] = field(default_factory=dict)
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        known = [(p, i) for i, (p, s) in enumerate(zip(self.pieces, self.scores)) if s is not None and p]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, _ in known):
            raise ValueError("a piece crosses a blank or holds a newline")
        self.lowest = min((s for s in self.scores if s is not None), default=0.0) - _UNKNOWN_COST
        self.spelled = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for byte, number in enumerate(self.bytes_ids):
            self.spelled[number] = bytes([byte])
        self._build(known)

    def parts(self) -> tuple[list[str], list[float | None], list[int]]:
        """What travels to the tasks; the trie is built there."""
        return self.pieces, self.scores, self.bytes_ids

    def _build(self, known: list[tuple[str, int]]) -> None:
        """Double-array trie: the child of state s by code c is base[s] + c if check there is s."""
        for character in sorted({c for p, _ in known for c in p}):
            self.codes[character] = len(self.codes) + 1
        root: dict = {}
        for piece, number in known:
            node = root
            for c in piece:
                node = node.setdefault(self.codes[c], {})
            node[0] = number
        width = len(self.codes) + 1
        self.base, self.check, self.value = [0], [-2], [-1]
        begin = 1  # the search for room starts here and moves on where slots get scarce
        waiting = [(0, root)]
        while waiting:
            state, node = waiting.pop()
            children = sorted(c for c in node if c)
            self.value[state] = node.get(0, -1)
            if not children:
                continue
            start = max(1, begin - children[0])
            tries = 0
            while any(start + c < len(self.check) and self.check[start + c] != -1 for c in children):
                start += 1
                tries += 1
            if tries > 32:
                begin = start + children[0]
            grow = start + children[-1] + 1 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            self.base[state] = start
            for c in children:
                self.check[start + c] = state
                waiting.append((start + c, node[c]))
        room = max(self.base) + width + 1 - len(self.check)  # so that no lookup leaves the arrays
        self.check += [-1] * room
        self.value += [-1] * room
        self.base += [0] * room

    def best_path(self, text: str) -> tuple[int, ...]:
        """Piece ids of the best path through ``text``, in which blanks are ``▁``."""
        base, check, value, scores = self.base, self.check, self.value, self.scores
        codes = [self.codes.get(c, 0) for c in text]
        n = len(codes)
        best, came, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, state, single, j = best[i], 0, False, i
            while j < n:
                code = codes[j]
                following = base[state] + code
                if not code or check[following] != state:
                    break
                state, j = following, j + 1
                piece = value[state]
                if piece >= 0:
                    single |= j == i + 1
                    score = here + scores[piece]
                    if score > best[j]:
                        best[j], came[j], by[j] = score, i, piece
            if not single and here + self.lowest > best[i + 1]:
                best[i + 1], came[i + 1], by[i + 1] = here + self.lowest, i, -1
        path: list[int] = []
        at = n
        while at:
            if by[at] >= 0:
                path.append(by[at])
            else:
                character = text[came[at]]
                raw = (SPACE if character == _OWN_SPACE else character).encode()
                path.extend(self.bytes_ids[b] for b in reversed(raw))
            at = came[at]
        return tuple(reversed(path))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(SPACE, _OWN_SPACE).replace(" ", SPACE)
        ids: list[int] = []
        memory = self.memory
        for stretch in _STRETCH.findall(marked):
            path = memory.get(stretch)
            if path is None:
                path = self.best_path(stretch)
                if len(stretch) <= _SHORT:
                    if len(memory) >= _MEMORY:
                        memory.clear()
                    memory[stretch] = path
            ids += path
        return ids

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "replace")


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; control, unknown and unused pieces never match."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in numbers]
    byte_ids = {pieces[i]: i for i in numbers if model.is_byte(i)}
    plain = [i for i in numbers if not (
        model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    )]
    stored = {i: model.get_score(i) for i in plain}
    if all(s == int(s) for s in stored.values()):
        order = sorted(plain, key=lambda i: (-stored[i], i))
        norm = math.log(sum(1 / (r + 1) for r in range(len(order))))
        stored = {i: -math.log(r + 1) - norm for r, i in enumerate(order)}
    return Vocabulary(pieces, [stored.get(i) for i in numbers], [byte_ids[f"<0x{b:02X}>"] for b in range(256)])


_loaded: dict[str, Vocabulary] = {}  # one trie per worker process and vocabulary


def _once(vocabulary: tuple, name: str) -> Vocabulary:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Vocabulary(*vocabulary)
    return _loaded[name]


def _encoder(vocabulary: tuple, name: str, check: bool, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _once(vocabulary, name)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                texts = batch.column("text").to_pylist()
                ids = [None if t is None else voc.encode(t) for t in texts]
                arrays, names = [batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"]
                if check:
                    arrays.append(pa.array([t is None or voc.decode(i) == t for t, i in zip(texts, ids)]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def encode(documents: DataFrame, path: str = MODEL, check: bool = False) -> DataFrame:
    """``row`` (the columns of ``documents (text, ...)``) and ``ids``; with ``check`` also ``round_trip``."""
    vocabulary = load(path).parts()
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "text")
    schema = StructType(packed.schema.fields[:1]).add("ids", ArrayType(IntegerType()))
    if check:
        schema = schema.add("round_trip", "boolean")
    return packed.mapInArrow(_encoder(vocabulary, path, check), schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded (ids, ...)`` with the ``decoded`` texts; null ids have none. A column of that name is replaced."""
    encoded = encoded.drop("decoded")
    vocabulary = load(path).parts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = _once(vocabulary, path)
        for batch in batches:
            texts = [None if i is None else voc.decode(i) for i in batch.column("ids").to_pylist()]
            arrays = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", "string"))
