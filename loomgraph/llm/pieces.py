"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The text gets a leading space, and spaces are written as U+2581. Reading it once, the automaton's state after each
character names the longest piece that ends there, and its output links the shorter ones; each relaxes the best score
at its end from the best score at its start (the sum of the pieces' scores is maximised, the longest last piece wins
ties). Characters that no piece covers cost the least score minus 10 and are written as byte pieces, or as the unknown
piece if the vocabulary has none. A U+2581 of the text itself is such a character, so that decoding gives the text back.

If no piece has a space after another character, the best path splits where spaces begin, and the paths of words with
the spaces before them are remembered (WORDS of them in a worker, those met last). Other vocabularies take each text in
one go.

A null text has null ids, no tokens, and comes back as null. An empty text has no tokens. Rows that repeat are encoded
alike.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import column, held_in_worker, prepare

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
WORDS, LONG = 300_000, 48
#: Fixed values of the file format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_RUNS = re.compile(" +[^ ]*")
_INFINITE = float("inf")
#: A step over one character that no piece covers: (length, piece, score), as in a state's outputs.
_UNKNOWN_STEP = (1, -1, 0.0)

Vocabulary = list[tuple[str, float, int]]


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol buffers message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def load(path: str = MODEL_FILE) -> Vocabulary:
    """(piece, score, kind) by id, from a model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == BYTE}
        self.unknown = next((i for i, v in enumerate(vocabulary) if v[2] == UNKNOWN), 0)
        usable = {p: (i, s) for i, (p, s, kind) in reversed(list(enumerate(vocabulary))) if kind in (NORMAL, USER_DEFINED) and p}
        self.penalty = min([s for _, s in usable.values()], default=0.0) - PENALTY
        self.by_word = all(SPACE not in piece.lstrip(SPACE) for piece in usable)
        self._build(usable)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in vocabulary]

    def _build(self, usable: dict[str, tuple[int, float]]) -> None:
        """Goto edges with failure links, and for each state its outputs: the pieces that end there, longest first, along the output links."""
        self.goto: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int, float]] = {}
        for piece, (i, score) in usable.items():
            at = 0
            for c in piece:
                at = self.goto[at].get(c) or self._node(at, c)
            own[at] = (len(piece), i, score)
        self.fail = [0] * len(self.goto)
        self.out: list[tuple[tuple[int, int, float], ...]] = [()] * len(self.goto)
        queue = deque(self.goto[0].values())
        while queue:
            at = queue.popleft()
            self.out[at] = ((own[at],) if at in own else ()) + self.out[self.fail[at]]
            for c, to in self.goto[at].items():
                self.fail[to] = self._along(self.fail[at], c) if at else 0
                queue.append(to)
        # Whether a piece of one character ends at a state.
        self.single = [bool(o) and o[-1][0] == 1 for o in self.out]
        self.steps: list[dict[str, int]] = [dict(g) for g in self.goto]

    def _along(self, state: int, c: str) -> int:
        while state and c not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(c, 0)

    def _step(self, state: int, c: str) -> int:
        """The state after c; steps along failure links are remembered for the common scripts, whose letters are few."""
        to = self._along(state, c)
        if c < "\u0250" or c == SPACE:
            self.steps[state][c] = to
        return to

    def _node(self, at: int, c: str) -> int:
        self.goto[at][c] = len(self.goto)
        self.goto.append({})
        return len(self.goto) - 1

    def best_path(self, text: str, literal: set[int] = frozenset()) -> list[int]:
        """Ids of the best path. Places in `literal` hold a U+2581 of the text itself."""
        best, back = [0.0], [_UNKNOWN_STEP]
        steps, out, single, penalty = self.steps, self.out, self.single, self.penalty
        state = 0
        for i, c in enumerate(text, 1):
            if literal and i - 1 in literal:
                state = 0
            else:
                to = steps[state].get(c)
                state = self._step(state, c) if to is None else to
            top, via = -_INFINITE, _UNKNOWN_STEP
            for link in out[state]:
                score = link[2] + best[i - link[0]]
                if score > top:
                    top, via = score, link
            if not single[state] and (score := best[-1] + penalty) > top:
                top, via = score, _UNKNOWN_STEP
            best.append(top)
            back.append(via)
        ids, at = [], len(text)
        while at:
            n, piece, _ = back[at]
            if piece >= 0:
                ids.append(piece)
            elif all(b in self.bytes for b in text[at - 1].encode("utf-8", "surrogatepass")):
                ids.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
            at -= n
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        """The packed ids of a word after a space; further spaces of its run may begin it."""
        if (packed := self.older.get(word)) is not None:
            self.memory[word] = packed
            return packed
        ids = self.best_path(SPACE + word.replace(" ", SPACE), {i + 1 for i, c in enumerate(word) if c == SPACE} if SPACE in word else frozenset())
        packed = array("i", ids).tobytes()
        if len(word) <= LONG:
            if len(self.memory) >= WORDS // 2:
                self.older, self.memory = self.memory, {}
            self.memory[word] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_word:
            return np.array(self.best_path(SPACE + text.replace(" ", SPACE), {i + 1 for i, c in enumerate(text) if c == SPACE}), np.int32)
        words = [w[1:] for w in _RUNS.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")
        packed = list(map(self.memory.get, words))
        if None in packed:
            packed = [self._word(w) if x is None else x for w, x in zip(words, packed)]
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encoder(spark: SparkSession, model_file: str = MODEL_FILE):
    """A column function: text to struct<token_ids, n_tokens, round_trip>. The vocabulary, half a megabyte, is broadcast."""
    shared, key = spark.sparkContext.broadcast(load(model_file)), uuid.uuid4().hex

    @F.pandas_udf("token_ids array<int>, n_tokens int, round_trip boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = held_in_worker(key, lambda: Codec(shared.value))
        for texts in batches:
            ids = [codec.encode(t) if isinstance(t, str) else None for t in texts]
            again = [i is None or codec.decode(i) == t for i, t in zip(ids, texts)]
            yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "n_tokens": [0 if i is None else len(i) for i in ids], "round_trip": again})

    return encode


def decoder(spark: SparkSession, model_file: str = MODEL_FILE):
    """A column function: token ids to text."""
    shared, key = spark.sparkContext.broadcast(load(model_file)), uuid.uuid4().hex

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = held_in_worker(key, lambda: Codec(shared.value))
        for ids in batches:
            yield pd.Series([None if i is None else codec.decode(i) for i in ids], dtype=object)

    return decode


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """[id_col, token_ids, n_tokens, round_trip]: one row per row of docs."""
    prepare(docs.sparkSession)
    encode = encoder(docs.sparkSession, model_file)
    return docs.select(column(id_col).alias("__id"), encode(column(text_col).cast("string")).alias("e")).select(F.col("__id").alias(id_col), "e.*")
