"""Attribute similarities. The built-in ones are column expressions; Jaro-Winkler and affine gap have none in Spark, so they are computed
once for each different pair of values, for all pairs of an Arrow batch at once, and joined back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import with_package, written

CUT = 0.85


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer; 0 for two empty texts or a missing one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(F.when(longest > 0, 1 - F.levenshtein(a, b) / longest), F.lit(0.0))


def at_least(similarity: Column, cut: float = CUT) -> Column:
    return (similarity >= cut).cast("double")


def exact(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def linear(a: Column, b: Column, scale: float = 0.1, offset: float = 0.0) -> Column:
    """1 up to the offset, one half at offset + scale, 0 from offset + 2 scale; 0 if a value is missing."""
    far = F.greatest(F.abs(a - b) - offset, F.lit(0.0))
    # greatest() skips nulls, so a missing value is caught first.
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - far / (2 * scale)))


def log_distance(a: Column, b: Column) -> Column:
    """Distance of the logarithms; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.abs(F.log10(a) - F.log10(b)))


def missing(a: Column, b: Column) -> Column:
    return (a.isNull() | b.isNull()).cast("double")


def padded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one row each, filled up with -1, and their lengths."""
    length = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), int(length.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, length


def in_batches(a: Sequence[str], b: Sequence[str], score: Callable[[list[str], list[str]], np.ndarray], cells: int = 1 << 20) -> np.ndarray:
    """The scores of the texts in each place, in batches of like lengths whose tables have about `cells` entries."""
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    order, out, at = np.argsort(size, kind="stable"), np.empty(len(size)), 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at) * (int(size[order[to]]) + 1) ** 2 < cells:
            to = min(len(order), to + max(1, (to - at) // 2))
        mine = order[at:to]
        out[mine] = score([a[i] for i in mine], [b[i] for i in mine])
        at = to
    return out


def _jaro_winkler(a: list[str], b: list[str], scale: float) -> np.ndarray:
    (x, nx), (y, ny) = padded(a), padded(b)
    n, wide, words = len(a), x.shape[1], max(1, -(-y.shape[1] // 64))
    place = np.arange(y.shape[1])
    # Where each character of a stands in b, and how far it may look, as bits of 64-bit words.
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0)
    bits = np.zeros((n, wide, words * 64), bool)
    bits[:, :, : len(place)] = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0) & (np.abs(np.arange(wide)[:, None] - place)[None] <= reach[:, None, None])
    seen = np.packbits(bits.reshape(n, wide, words, 64), axis=3, bitorder="little").view(np.uint64).reshape(n, wide, words)
    used, hit = np.zeros((n, words), np.uint64), np.zeros((n, wide), bool)
    for i in range(wide):
        for w in range(words):
            free = np.where(hit[:, i], np.uint64(0), seen[:, i, w] & ~used[:, w])
            used[:, w] |= free & (~free + np.uint64(1))
            hit[:, i] |= free != 0
    taken = np.unpackbits(used.view(np.uint8), axis=1, bitorder="little")[:, : len(place)].astype(bool)
    m = hit.sum(1)
    most = int(m.max(initial=0))
    # Matched characters of both sides in their order, side by side.
    first, second = (np.take_along_axis(v, np.argsort(~f, axis=1, kind="stable")[:, :most], 1) for v, f in ((x, hit), (y, taken)))
    swapped = ((first != second) & (np.arange(most) < m[:, None])).sum(1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(nx, 1) + m / np.maximum(ny, 1) + (m - swapped) / some) / 3, 0.0)
    head = min(4, wide, y.shape[1])
    same = np.cumprod((x[:, :head] == y[:, :head]) & (x[:, :head] >= 0), axis=1).sum(1) if head else np.zeros(n, int)
    score = np.where(jaro > 0.7, jaro + same * scale * (1 - jaro), jaro)
    return np.where([p == q for p, q in zip(a, b, strict=True)], (nx > 0).astype(float), score)


def jaro_winkler_all(a: Sequence[str], b: Sequence[str], scale: float = 0.1) -> np.ndarray:
    """Jaro-Winkler of all pairs of a batch: matches within half the longer text's length, half the transpositions, and a bonus for up to four equal first characters.

    Each character of every a takes the first free one of its window in b, found in all pairs at once as the lowest bit of a mask."""
    return in_batches(a, b, lambda x, y: _jaro_winkler(x, y, scale))


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    return float(jaro_winkler_all([a], [b], scale)[0])


def _affine_gap(a: list[str], b: list[str], mismatch: float, gap: float, space: float, match: float) -> np.ndarray:
    (x, nx), (y, ny) = padded(a), padded(b)
    n, wide = len(a), y.shape[1]
    step = space * np.arange(wide + 1)
    best = np.broadcast_to(np.concatenate([[0.0], gap + step[:-1]]), (n, wide + 1)).copy()
    down, out = np.full((n, wide + 1), np.inf), np.zeros(n)
    for i in range(x.shape[1]):
        down = np.minimum(down + space, best + gap)
        now = down.copy()
        np.minimum(now[:, 1:], best[:, :-1] + np.where(x[:, i, None] == y, match, mismatch), out=now[:, 1:])
        now[:, 0] = gap + space * i
        # A gap to the right that opens at k costs gap + space * (j - 1 - k): the least over all k is a running minimum.
        right = np.minimum.accumulate(now - step, axis=1)[:, :-1] + gap + step[:-1]
        np.minimum(now[:, 1:], right, out=now[:, 1:])
        best = now
        done = nx == i + 1
        out[done] = best[done, ny[done]]
    return np.where((nx > 0) & (ny > 0), out / np.maximum(nx + ny, 1), 1.0)


def affine_gap_all(a: Sequence[str], b: Sequence[str], mismatch: float = 11.0, gap: float = 10.0, space: float = 7.0, match: float = 1.0) -> np.ndarray:
    """Least cost of aligning two texts, where a run of gaps costs `gap` (no less than `space`) to open and `space` for each further character, over the sum of their lengths; 1 if one is empty.

    Of all pairs of a batch at once, a row of the three tables (pairs, gaps down, gaps right) at a time."""
    if gap < space:
        raise ValueError("a gap that is dearer to go on than to open isn't one")
    return in_batches(a, b, lambda x, y: _affine_gap(x, y, mismatch, gap, space, match))


def affine_gap(a: str, b: str) -> float:
    return float(affine_gap_all([a], [b])[0])


#: Entries of a dictionary that are sent to every task (some 10 MB).
MOST_SENT = 100_000


def by_dictionary(pairs: DataFrame, a: str, b: str, out: str, score: Callable[[Sequence[str], Sequence[str]], np.ndarray], symmetric: bool = True, values: DataFrame | None = None) -> DataFrame:
    """`pairs` with the column `out`: the score of the texts in columns a and b, computed once for each different pair of them.

    `values` (x, y) may name the pairs of values that can occur, where they come cheaper than from the pairs themselves, which are then read once only.
    Equal texts never leave the JVM. A symmetric score is computed for one order only. The dictionary is written and counted: one of up to MOST_SENT entries is sent to all tasks, so that pairs, which are many more, stay where they are; a larger one is joined as Spark sees fit."""
    with_package(pairs.sparkSession)
    known = F.col(a).isNotNull() & F.col(b).isNotNull()  # least() and greatest() skip nulls
    low, high = (F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b))) if symmetric else (F.col(a), F.col(b))

    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(score(x.tolist(), y.tolist()), dtype="float64")

    keyed = pairs.withColumn("_da", low).withColumn("_db", high)
    if values is None:
        occurring = keyed.select("_da", "_db")
    else:
        occurring = values.select((F.least("x", "y") if symmetric else F.col("x")).alias("_da"), (F.greatest("x", "y") if symmetric else F.col("y")).alias("_db"))
    found = occurring.where("_da <> _db").distinct().select(F.col("_da").alias("_ka"), F.col("_db").alias("_kb"), scored("_da", "_db").alias(out))
    found = written(found, "dictionary")
    found = F.broadcast(found) if found.count() <= MOST_SENT else found
    joined = keyed.join(found, (F.col("_da") == F.col("_ka")) & (F.col("_db") == F.col("_kb")), "left")
    alike, none = (F.lit(float(score([t], [t])[0])) for t in ("a", ""))
    same = F.when(F.col("_da") == F.col("_db"), F.when(F.col("_da") != "", alike).otherwise(none))
    return joined.withColumn(out, F.coalesce(F.col(out), same, none)).drop("_da", "_db", "_ka", "_kb")


#: Scores of pairs of texts that a Python worker has computed, by the function's name; forgotten when they are more than MOST_KNOWN.
_known: dict[tuple[str, str, str], float] = {}
MOST_KNOWN = 1 << 20


def levenshtein_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """`levenshtein_similarity` of the texts in each place."""
    return np.array([_levenshtein(x, y) for x, y in zip(a, b, strict=True)], float)


def _levenshtein(a: str, b: str) -> float:
    if not a and not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def in_table(a: Sequence[str | None], b: Sequence[str | None], score: Callable[[Sequence[str], Sequence[str]], np.ndarray]) -> np.ndarray:
    """The score of each text of a with each of b, as `by_dictionary` has it for a symmetric score; a worker computes that of a pair of different texts once."""
    alike, none = (float(score([t], [t])[0]) for t in ("a", ""))
    pair = lambda x, y: (score.__name__, min(x, y), max(x, y))
    wanted = {pair(x, y) for x in a if x is not None for y in b if y is not None and x != y}
    if len(_known) + len(wanted) > MOST_KNOWN:
        _known.clear()
    new = [w for w in wanted if w not in _known]
    _known.update(zip(new, score([w[1] for w in new], [w[2] for w in new]).tolist() if new else [], strict=True))
    one = lambda x, y: none if x is None or y is None or x == y == "" else alike if x == y else _known[pair(x, y)]
    return np.array([[one(x, y) for y in b] for x in a], float).reshape(len(a), len(b))


def codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The different values of a column, with null, and which of them each row has."""
    coded = column.combine_chunks().dictionary_encode("encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, and where they are missing."""
    missing_ = column.is_null().to_numpy()
    return column.fill_null(0.0).to_numpy().astype(float), missing_


class Texts:
    """Rows of two tables by some text columns: which combination of values each row has, and for each column a table of a score over the combinations of both sides."""

    def __init__(self, a: pa.Table, b: pa.Table, columns: Sequence[str]):
        self.columns, self.values, self.own, self.row = list(columns), [], [], []
        for table in (a, b):
            found = [codes(table.column(c)) for c in columns]
            own, row = np.unique(np.stack([c for _, c in found], 1), axis=0, return_inverse=True)
            self.values.append([v for v, _ in found])
            self.own.append(own)
            self.row.append(row.reshape(-1))

    def by(self, column: str, score: Callable[[list, list], np.ndarray]) -> np.ndarray:
        """score(values of a, values of b), a table, for the combinations."""
        k = self.columns.index(column)
        return score(self.values[0][k], self.values[1][k])[self.own[0][:, k][:, None], self.own[1][:, k]]

    def spread(self, table: np.ndarray, i: slice, j: slice) -> np.ndarray:
        """A table of combinations for stretches of rows."""
        return np.take(table[self.row[0][i]], self.row[1][j], axis=1)
