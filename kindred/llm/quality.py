"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines of one text.

Words are runs of anything but the space and the characters tab to carriage return. Word hashes roll into hashes of n-grams of
several lengths; whatever repeats in the same text is marked, and the marked characters are held against the text's word characters.
A longer n-gram can only repeat where the shorter one does, so each length looks at what the last one left.

Edge cases: a null text counts as a text without words (all counts 0, it fails the base rule); texts of any length are read whole; repeated
rows are judged alike, one result a row; an empty table gives an empty result; other columns, whatever their names, are ignored by `profile`
and passed through by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V

MIN_WORDS = 50
#: Highest share of words in repeated 3-word windows, in percent.
MAX_REPEAT_PERCENT = 50
#: n-gram length and the highest share of word characters that duplicated n-grams of that length may cover.
NGRAM_LIMITS = ((5, 0.30), (6, 0.28), (8, 0.25), (10, 0.22))
#: Highest share of word characters in lines that repeat an earlier line.
MAX_DUP_LINE_CHARS = 0.30
#: Highest number of symbols for each word.
MAX_SYMBOLS_PER_WORD = 0.2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

PROFILE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, ngram_chars array<long>, base_failed boolean, kept boolean"


def _marked_words(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    depth = np.zeros(n_words + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + length, -1)
    return np.cumsum(depth[:-1]) > 0


def measure(text, ngram_limits=NGRAM_LIMITS, max_dup_line_chars=MAX_DUP_LINE_CHARS, max_symbols=MAX_SYMBOLS_PER_WORD) -> dict[str, np.ndarray]:
    """The profile of each text of an Arrow string column."""
    buf, offsets = V.text_buffer(text)
    n = len(offsets) - 1
    words, points = V.Words(buf, offsets), V.code_points(buf)
    rolling = [V.Rolling(buf, k) for k in (0, 1)]
    row, n_all = words.row, len(words.start)
    per_row = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64)
    length = points[words.end] - points[words.start]
    salt = V.mix(np.arange(1, n + 1, dtype=np.uint64))
    out = {"n_words": per_row(row), "word_chars": per_row(row, length), "n_symbols": per_row(V.rows_of(offsets, np.flatnonzero(_SYMBOL[buf])))}

    start, end, line_row = V.lines_of(buf, offsets)
    first_word = np.searchsorted(words.start, start)
    past_word = np.searchsorted(words.start, end)
    full = past_word > first_word
    start, end, line_row, first_word, past_word = (x[full] for x in (start, end, line_row, first_word, past_word))
    _, later = V.repeated(rolling[0].spans(start, end) ^ salt[line_row], rolling[1].spans(start, end))
    chars_before = np.concatenate([[0], np.cumsum(length)])
    line_chars = chars_before[past_word] - chars_before[first_word]
    out["n_dup_lines"] = per_row(line_row[later])
    out["dup_line_chars"] = per_row(line_row[later], line_chars[later])

    # Both hashes of a word go into both hashes of an n-gram.
    each = [r.spans(words.start, words.end) for r in rolling]
    each[1] = V.mix(each[0] + each[1])
    grams = [V.Rolling(h, k) for k, h in enumerate(each)]

    def repeats(at, size):
        return V.repeated(grams[0].spans(at, at + size) ^ salt[row[at]], grams[1].spans(at, at + size))[0]

    at = np.flatnonzero(row[2:] == row[:-2]) if n_all > 2 else np.zeros(0, np.int64)
    at = at[repeats(at, 3)]
    covered = _marked_words(n_all, at, 3)
    out["n_repeat_words"] = per_row(row[covered])
    shares = []
    for size, _ in ngram_limits:
        at = at[at + size <= n_all]
        at = at[row[at + size - 1] == row[at]]
        at = at[repeats(at, size)]
        covered = _marked_words(n_all, at, size)
        shares.append(per_row(row[covered], length[covered]))
    out["ngram_chars"] = np.stack(shares, 1) if shares else np.zeros((n, 0), np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    limits = np.array([limit for _, limit in ngram_limits])
    bad = (out["ngram_chars"] > limits * out["word_chars"][:, None]).any(1)
    bad |= out["dup_line_chars"] > max_dup_line_chars * out["word_chars"]
    bad |= out["n_symbols"] > max_symbols * out["n_words"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the counts of PROFILE, base_failed and kept."""
    V.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                got = measure(part.column("_text"))
                grams = got.pop("ngram_chars")
                arrays = {k: pa.array(v) for k, v in got.items()}
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1) * grams.shape[1], pa.int32()), pa.array(grams.ravel()))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "ngram_chars", "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(flat if k == "ngram_chars" else arrays[k] for k in names)], names=["_id", *names])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, {PROFILE}").withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; one narrow pass, nothing is shuffled."""
    V.tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, text_col):
                yield part.filter(pa.array(measure(part.column(text_col))["kept"]))

    return docs.mapInArrow(run, docs.schema)
