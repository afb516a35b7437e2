"""Similarities in batches, and the join on what similar names share."""

import random

import numpy as np
import pytest
from test_learn import plain_gap

from kindred.functions import similarity as S
from kindred.operators import similar


def plain_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    reach, free, first = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                first.append(x)
                break
    second = [y for y, f in zip(b, free, strict=True) if not f]
    m = len(first)
    if not m:
        return 0.0
    j = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(first, second, strict=True)) // 2) / m) / 3
    same = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def texts(seed, n, most, letters="abcdé 😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("most", [12, 70, 200])
def test_jaro_winkler_of_a_batch(most):
    n = 4000 if most < 100 else 300
    a, b = texts(1, n, most), texts(2, n, most)
    b[: n // 2] = [x[:k % 7] + y for k, (x, y) in enumerate(zip(a[: n // 2], b[: n // 2], strict=True))]
    assert np.allclose(S.jaro_winkler_all(a, b), [plain_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], atol=1e-12)


def test_affine_gap_of_a_batch():
    a, b = texts(3, 10_000, 8, "abc"), texts(4, 10_000, 8, "abc")
    assert np.allclose(S.affine_gap_all(a, b), [plain_gap(x, y) for x, y in zip(a, b, strict=True)])
    assert S.affine_gap_all([], []).tolist() == []
    with pytest.raises(ValueError, match="gap"):
        S.affine_gap_all(["a"], ["b"], gap=1.0)


@pytest.mark.parametrize(("letters", "most", "cut"), [("abcdefgh", 14, 0.85), ("ab", 9, 0.85), ("abcdefghijklmnopqrst", 30, 0.92), ("abcd é😀", 7, 0.75)])
def test_join_loses_no_pair(spark, letters, most, cut):
    names = sorted(set(texts(5, 220, most, letters)) | {x[:-1] + "b" for x in texts(5, 60, most, letters)})
    df = spark.createDataFrame([(x,) for x in [*names, *names[:9], None]], "name string")
    got = {(r["a"], r["b"]): r["s"] for r in similar.jaro_winkler_join(df, "name", cut).collect()}
    plain = {(x, y): plain_jaro_winkler(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if x and y}
    want = {k: s for k, s in plain.items() if s >= cut - 1e-9}
    assert {(min(k), max(k)) for k in got} == {(min(k), max(k)) for k in want} and len(want) > 10
    assert all(abs(s - plain_jaro_winkler(*k)) < 1e-12 for k, s in got.items())
    assert similar.jaro_winkler_join(df.where("false"), "name", cut).count() == 0


def test_join_of_many_names(spark):
    """100,000 different names: the planted likes are found and few of the 5,000,000,000 pairs are scored."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = {"".join(rng.choice(letters) for _ in range(12)) for _ in range(99_000)}
    planted = set()
    for x in sorted(names)[:1000]:
        y = x[:6] + x[7] + x[6] + x[8:]
        if x != y:
            planted.add((min(x, y), max(x, y)))
    names |= {x for pair in planted for x in pair}
    df = spark.createDataFrame([(x,) for x in sorted(names)], "name string").repartition(8)
    got = {(r["a"], r["b"]) for r in similar.jaro_winkler_join(df, "name", 0.9).collect()}
    assert planted <= got
    assert all(plain_jaro_winkler(a, b) >= 0.9 - 1e-9 for a, b in sorted(got)[:500])


def test_names_have_all_their_pairs(spark, sf_dir):
    from kindred.plans import queries

    names = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()}
    got = queries.jaro_winkler_names(spark, sf_dir).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in names for b in names if a < b} and len(got) == len(names) * (len(names) - 1) // 2


def test_pairs_of_all_values_in_tiles(spark, monkeypatch):
    from kindred.operators import blocking, similar

    monkeypatch.setattr(blocking, "TILE_ROWS", 3)
    values = ["", "a", "ab", "abc", "b", "xyz", "xy", "martha", "marhta", None, "a"]
    got = similar.jaro_winkler_pairs(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()
    some = sorted({v for v in values if v is not None})
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in some for b in some if a < b} and len(got) == len(some) * (len(some) - 1) // 2
    assert {(r["a"], r["b"]): round(r["s"], 4) for r in got}["marhta", "martha"] == 0.9611
