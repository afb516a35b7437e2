"""The n-gram Jaccard join against all pairs."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASHING, SCHEMA, texts

from kindred.llm import queries, setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def plain_join(rows, percent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    low = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return sorted(((doc, len(s), low(i) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(seed=6):
    """Chains and stars of near copies about the threshold, texts that share most of a passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, out = [word() for _ in range(80)], []
    for length in (8, 11, 12, 20, 45, 120, 300):
        base = [word() for _ in range(length)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy[: len(copy) - rng.randrange(1 + length // 12)]))
        for _ in range(6):  # each a step from the last one
            base = base[1:] + [word()]
            out.append(" ".join(base))
    for _ in range(30):  # alike, but not enough: a fifth is their own
        out.append(" ".join(passage + [word() for _ in range(20)]))
    for _ in range(12):
        out.append(" ".join(passage + [word() for _ in range(rng.randrange(6))]))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    every = texts() + near_copies()
    out = list(enumerate(every)) + [(3, every[3]), (None, every[3]), (None, "no id at all here"), (None, None), (5000, every[0].upper()), (5001, "a"), (5002, "A"), (5003, "a b"), (5004, "a\tb"), (5005, "a b b")]
    return [(doc, t, "en", "s", 0) for doc, t in out]


@pytest.mark.parametrize(("percent", "group", "tokens"), [(90, 64, 1 << 20), (90, 3, 400), (70, 1, 50)])
def test_join(spark, rows, monkeypatch, percent, group, tokens):
    for name, value in (("GROUP", group), ("GROUP_TOKENS", tokens), ("QUERY_TOKENS", 2 * tokens)):
        monkeypatch.setattr(setjoin, name, value)
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in [*CLASHING, "_set", "_key", "_group", "_t"])).repartition(5)
    got = [tuple(r) for r in setjoin.joined(docs, percent=percent).collect()]
    assert sorted(got, key=str) == plain_join([r[:2] for r in rows], percent)
    if group == 64 and percent == 90:
        assert setjoin.joined(docs.where("false")).count() == 0


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(9, 400))
        common = rng.integers(0, 1 << 60, n).astype(np.uint64)
        a, b = int(rng.integers(0, n // 18 + 1)), int(rng.integers(0, n // 18 + 1))
        one, two = np.concatenate([common, rng.integers(0, 1 << 60, a).astype(np.uint64)]), np.concatenate([common, rng.integers(0, 1 << 60, b).astype(np.uint64)])
        if 100 * n < 90 * (n + a + b) or a + b == 0:
            continue
        row = np.repeat([0, 1], [len(one), len(two)])
        of, key = setjoin.part_keys(row, np.concatenate([one, two]), 2)
        assert set(key[of == 0]) & set(key[of == 1]), (n, a, b)


def test_groups_open_only_where_the_union_allows():
    lists = lambda *xs: pa.array(xs, pa.list_(pa.int64()))
    members = lists(list(range(100)), list(range(50, 150)), list(range(5, 105)))
    asking = lists(list(range(1, 100)), list(range(500, 600)), list(range(40, 140)), [])
    size = lambda x: np.array([len(v) for v in x.to_pylist()])
    inner, outer = setjoin.opened(members, size(members), None, asking, size(asking), None, 90)
    assert inner == [(0, 2)] and outer == [(0, 0)]
    # With roots, an own component gives no link.
    assert setjoin.opened(members, size(members), np.array([4, 5, 4]), asking, size(asking), np.array([4, 1, 2, 3]), 90)[1] == []


def test_join_sql(spark, sf_dir, duck, agrees):
    got = queries.op13_ngram_jaccard_join(spark, sf_dir).toPandas()
    assert len(got)
    agrees(got, duck.execute(queries.ORACLE_SQL["op13_ngram_jaccard_join"]).df())


def test_join_sql_of_odd_rows(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert sorted(con.execute(queries.ORACLE_SQL["op13_ngram_jaccard_join"]).fetchall(), key=str) == plain_join([r[:2] for r in rows])
