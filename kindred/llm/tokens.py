"""Token counts by a linear longest-match automaton.

Greedy word pieces: from the left, the longest vocabulary piece that matches is taken, then the next, to the word's end. Pieces are byte strings;
some are valid anywhere, others only where they end the word. A vocabulary trie gets failure links (where the match goes on once pieces have been
taken off its left) and the number of pieces taken on the way, so a word's count is a walk over its bytes that never builds a piece. All words of
a batch walk side by side, one byte of each at a time. A byte that starts no piece is a piece of its own.

Edge cases: a null or empty text has 0 tokens; texts of any length are read whole; repeated rows are counted alike; an empty table gives an empty
result; other columns are ignored. Texts are lower-cased first unless `lower` is False. A vocabulary whose trie has 262,144 nodes or more is refused: a step is one
32-bit number with 18 bits for the state. The step table takes 1 KB a node in every Python worker.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

_POPS = 18
_automata: dict[tuple, Automaton] = {}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def read_vocabulary(path: str, word_end: str = "</w>") -> tuple[list[bytes], list[bytes]]:
    """Pieces valid anywhere, and pieces valid at a word's end, of a byte-level tokenizer file."""
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", ())}
    inner, final = [], []
    for token in file["model"]["vocab"]:
        if token in special:
            continue
        body, pieces = (token[: -len(word_end)], final) if word_end and token.endswith(word_end) else (token, inner)
        if body:
            pieces.append(bytes(symbols[c] for c in body))
    return inner, final


class Automaton:
    """step[state * 256 + byte] holds the next state and, above it, the number of pieces popped; ends[state] the pieces left at a word's end."""

    def __init__(self, inner: list[bytes], final: list[bytes]):
        children: list[dict[int, int]] = [{}]
        is_inner, is_final, parent, label = [False], [False], [0], [0]

        def node(piece: bytes) -> int:
            at = 0
            for byte in piece:
                to = children[at].get(byte)
                if to is None:
                    to = children[at][byte] = len(children)
                    children.append({})
                    is_inner.append(False)
                    is_final.append(False)
                    parent.append(at)
                    label.append(byte)
                at = to
            return at

        for piece in inner:
            is_inner[node(piece)] = True
        for piece in final:
            is_final[node(piece)] = True
        for byte in range(256):
            is_inner[node(bytes([byte]))] = True
        n = len(children)
        if n >= 1 << _POPS:
            raise ValueError(f"the vocabulary's trie has {n} nodes; {1 << _POPS} are supported")
        fail, popped = np.zeros(n, np.int32), np.zeros(n, np.int32)
        step = np.zeros((n, 256), np.int32)
        ends = np.zeros(n, np.int32)
        for byte, to in children[0].items():
            step[0, byte] = to
        level = list(children[0].values())
        while level:
            following = []
            for v in level:
                # The parent's failure state, one byte further on, is where this node fails to; a whole piece fails to the root instead.
                if is_inner[v]:
                    fail[v], popped[v] = 0, 1
                else:
                    u = parent[v]
                    moved = int(step[fail[u], label[v]])
                    fail[v], popped[v] = moved & ((1 << _POPS) - 1), popped[u] + (moved >> _POPS)
                step[v] = step[fail[v]] + (popped[v] << _POPS)
                for byte, to in children[v].items():
                    step[v, byte] = to
                    following.append(to)
                ends[v] = 1 if is_inner[v] or is_final[v] else popped[v] + ends[fail[v]]
            level = following
        self.step, self.ends = step.ravel(), ends

    def count(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:end]."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, pieces = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), "left")
        for k in range(longest):
            m = active[k]
            moved = self.step[(state[:m].astype(np.int64) << 8) + buf[start[:m] + k]]
            state[:m] = moved & ((1 << _POPS) - 1)
            pieces[:m] += moved >> _POPS
        out = np.zeros(len(order), np.int64)
        out[order] = pieces + self.ends[state]
        return out


def automaton(key: tuple, inner: list[bytes], final: list[bytes]) -> Automaton:
    """Built once in each worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(inner, final)
    return _automata[key]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", word_end: str = "</w>", lower: bool = True) -> DataFrame:
    """One row a document: id, n_words and n_tokens. The driver reads the vocabulary; its size bounds what is sent to executors."""
    V.tune(docs.sparkSession)
    inner, final = read_vocabulary(vocabulary, word_end)
    pieces = docs.sparkSession.sparkContext.broadcast((inner, final))
    key = (vocabulary, word_end, len(inner), len(final))

    def run(batches):
        walk = automaton(key, *pieces.value)
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                buf, offsets = V.text_buffer(part.column("_text"))
                words = V.Words(buf, offsets)
                n = part.num_rows
                counts = np.bincount(words.row, walk.count(buf, words.start, words.end), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(np.bincount(words.row, minlength=n)), pa.array(counts.astype(np.int64))], names=["_id", "n_words", "n_tokens"]
                )

    text = F.lower(F.col(text_col)) if lower else F.col(text_col)
    src = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, n_words long, n_tokens long").withColumnRenamed("_id", id_col)
