"""Similarity joins over one column's different values."""

from __future__ import annotations

import math
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.operators import blocking
from kindred.session import with_package, written

SCALE = 0.1
#: Letters of a key for each length of the common beginning (0 to 4): the longer it is, the fewer are needed to tell texts apart.
LETTERS = (3, 2, 2, 1, 1)
#: Letters whose counts come to the driver; the rest of a larger alphabet counts as equally rare.
MOST_LETTERS = 100_000


def least_jaro(cut: float, same: int, scale: float = SCALE) -> float:
    """The Jaro similarity that a pair with `same` equal first characters needs to reach the cut."""
    return max((cut - scale * same) / (1 - scale * same), min(cut, 0.7))


def _need(cut: float, same: int) -> float:
    """Jaro is at most (m / a + m / b + 1) / 3 with m matches in texts of a and b characters: what m / a + m / b must reach."""
    return 3 * least_jaro(cut, same) - 1


def _letters(text: str) -> list[tuple[str, int]]:
    """Each character with the number of equal ones before it: texts share as many of these as they have characters in common."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        out.append((c, seen.get(c, 0)))
        seen[c] = out[-1][1] + 1
    return out


def _masks(letters: list[tuple[str, int]]) -> int:
    out = 0
    for c, k in letters:
        out |= 1 << ((ord(c) * 7 + k * 29) % 64)
    return out - (1 << 64) if out >> 63 else out


def keys_of(text: str, cut: float, shortest: int, rank: dict) -> list[str]:
    """Keys of which two texts that reach the cut share one at least.

    With the first `same` characters in common, they have at least o characters in common, o growing with the lengths. So of the n - o + r rarest characters of either, r are common to both; every r of them are a key, with the
    beginning. r is LETTERS[same], or o where that is less; a short text has keys of every r from its o up, and so one with any longer text."""
    n, out = len(text), []
    letters = sorted(_letters(text), key=lambda x: (rank.get(x, 0), x))
    for same in range(min(4, n) + 1):
        need = _need(cut, same)
        least = max(shortest, same, math.ceil((need - 1) * n - 1e-9))
        common = max(1, math.ceil(need * n * least / (n + least) - 1e-9))
        for r in range(min(LETTERS[same], common), LETTERS[same] + 1):
            out += [f"{same}|{text[:same]}|" + "|".join(f"{c}{k}" for c, k in sorted(some)) for some in combinations(letters[: n - common + r], r)]
    return out


def _may_reach(cut: float) -> Column:
    """Bounds on lengths and common characters, from masks: characters of one text that have no bit in the other's are not in it."""
    same = F.lit(0)
    for k in range(1, 5):
        same = same + (F.substring("a", 1, k) == F.substring("b", 1, k)).cast("int") * (F.least("n_1", "n_2") >= k).cast("int")
    need = F.element_at(F.array(*(F.lit(_need(cut, k)) for k in range(5))), same + 1)
    most = F.least(F.col("n_1") - F.bit_count(F.col("m_1").bitwiseAND(F.bitwise_not("m_2"))), F.col("n_2") - F.bit_count(F.col("m_2").bitwiseAND(F.bitwise_not("m_1"))))
    return most * (1 / F.col("n_1") + 1 / F.col("n_2")) >= need - 1e-9


def _scored(pairs: DataFrame, cut: float | None) -> DataFrame:
    """(a, b, s) of pairs (a, b), scored in batches; with a cut, those that reach it."""

    def scored(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(S.jaro_winkler_all(a, b), pa.float64())], names=["a", "b", "s"])
            yield out if cut is None else out.filter(pa.array(out.column("s").to_numpy() >= cut - 1e-9))

    return pairs.mapInArrow(scored, "a string, b string, s double")


def jaro_winkler_pairs(values: DataFrame, column: str) -> DataFrame:
    """(a, b, s): all pairs a < b of different values with their Jaro-Winkler similarity. Null values have no pairs. Pairs are dealt out in tiles and scored as they are made."""
    with_package(values.sparkSession)
    texts = written(values.select(F.col(column).alias("t")).where("t IS NOT NULL").distinct(), "texts")
    rows = texts.select(F.lit(0).alias("_all"), "t", F.lit(texts.count()).alias("block_size"))
    return _scored(blocking.different_pairs(rows, ["_all"], "t").select(F.col("x").alias("a"), F.col("y").alias("b")), None)


def jaro_winkler_join(values: DataFrame, column: str, cut: float = S.CUT) -> DataFrame:
    """(a, b, s): pairs a < b of different values whose Jaro-Winkler similarity s is at least `cut`. No pair is made that shares no key or that the bounds rule out; the others are scored in batches. Null and empty values have no pairs."""
    with_package(values.sparkSession)
    texts = written(values.select(F.col(column).alias("t")).where(F.length(column) > 0).distinct(), "texts")
    shortest = texts.agg(F.coalesce(F.min(F.length("t")), F.lit(1))).first()[0]

    def letters(batches):
        for batch in batches:
            each = [x for t in batch.column("t").to_pylist() for x in _letters(t)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in each], pa.string()), pa.array([k for _, k in each], pa.int32())], names=["c", "k"])

    counts = texts.mapInArrow(letters, "c string, k int").groupBy("c", "k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c", "k").limit(MOST_LETTERS)
    rank = {(r["c"], r["k"]): r["n"] for r in counts.collect()}

    def keyed(batches):
        for batch in batches:
            rows = [(t, len(t), _masks(_letters(t)), keys_of(t, cut, shortest, rank)) for t in batch.column("t").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["t", "n", "m", "keys"])

    index = texts.mapInArrow(keyed, "t string, n int, m long, keys array<string>").select("t", "n", "m", F.explode(F.transform("keys", lambda k: F.xxhash64(k))).alias("key"))
    index = written(index, "keys")
    side = lambda name, i: index.select("key", F.col("t").alias(name), F.col("n").alias(f"n_{i}"), F.col("m").alias(f"m_{i}"))
    pairs = side("a", 1).join(side("b", 2), "key").where((F.col("a") < F.col("b")) & _may_reach(cut)).select("a", "b").distinct()

    return _scored(pairs, cut)
