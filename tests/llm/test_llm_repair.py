"""Conversation repair against a plain search for the cheapest edits, from the end of a conversation to its beginning."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASHING

from kindred.llm import queries, repair

FULL = re.compile(r"[^\x20\x09-\x0D]")
FORM = re.compile(r"(s?(ua)+)?")


def moves(state):
    """Role initials that may come next, with the state after them; the state is what was last: '', s, u or a."""
    return {"": "su", "s": "u", "u": "a", "a": "u"}[state]


def plain_edits(rows):
    """(cost, audit, lines) of rows (role, text, must_go, truncated): the least cost and then the least audit."""

    @functools.cache
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            for to in moves(state):
                if to != "s":
                    role = {"u": "user", "a": "assistant"}[to]
                    cost, audit, lines = best(i, to, inserts + 1)
                    ways.append((cost + 3, "I" + audit, (role + ":", *lines)))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, lines))
            for to in () if must_go else moves(state):
                if role[:1] == to:
                    cost, audit, lines = best(i + 1, to, 0)
                    ways.append((cost + 3 * truncated, "K" + audit, (f"{role}:{text}", *lines)))
                if to != "s":
                    cost, audit, lines = best(i + 1, to, 0)
                    ways.append((cost + 3 + 3 * truncated, "R" + audit, ({"u": "user", "a": "assistant"}[to] + ":" + text, *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_repair(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        shown = lambda x: " " if x is None else str(x)
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            full = FULL.findall(text)
            fault = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append((role, text, fault in (0, 1), fault == 2))
            if fault is not None:
                counts[fault] += 1
        turns = [t for t, *_ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = plain_edits(tuple(faults))
        assert FORM.fullmatch("".join(x[0] for x in lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed=1, conversations=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", "  \t\n", "Really? ", "é ", "What!\x0b\x0c", "go. on", None, "\x1f", "a:b\nc.", "long " * 300 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "supervisor"]
    out = []
    for conv in range(conversations):
        alternating = rng.random() < 0.5
        for turn in range(rng.randrange(1, 12)):
            role = ("user", "assistant")[turn % 2] if alternating and rng.random() < 0.8 else rng.choice(roles)
            out.append((conv, None if rng.random() < 0.08 else turn * rng.choice([1, 1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {turn}."))
    out += [(None, t, "user", "x.") for t in range(3)] + [(None, None, None, None), (900, 5, "user", "the same."), (900, 5, "user", "the same."), (901, None, "assistant", "only")]
    out += [(c, 0, "user", "gone.") for c in range(1000, 1030) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return out


COLUMNS = ["conv_id", "turn", "role", "text"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows_of(), "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in [*CLASHING, "_conv", "_turn", "_kind", "_copy", "cost", "audit"])).repartition(4)


@pytest.mark.parametrize(("long_rows", "segment"), [(repair.LONG_ROWS, repair.SEGMENT), (0, 1), (3, 3), (0, 100)])
def test_repair(table, long_rows, segment):
    got = repair.repair(table, long_rows=long_rows, segment=segment).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repair(rows_of())
    assert repair.repair(table.where("false"), long_rows=long_rows).count() == 0


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(5000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", ""]) if rng.random() < 0.3 else f"t {t}.") for t in range(600)] + rows_of(3, 20)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {r["conv_id"]: tuple(r) for r in repair.repair(table).collect()}
    got = {r["conv_id"]: tuple(r) for r in repair.repair(table, long_rows=100, segment=37).collect()}
    assert got == want and len(want[5000][7]) > 500
    parts = sorted(plain_repair(rows_of(3, 20)), key=str)
    assert sorted((v for k, v in got.items() if k != 5000), key=str) == parts


def test_trie_shares_prefixes_and_starts_anew(monkeypatch):
    made = []
    monkeypatch.setattr(repair, "next_layer", lambda layer, sign, f=repair.next_layer: made.append(sign) or f(layer, sign))
    trie = repair.Trie()
    for signature in sorted(["suau", "suaU", "suax", "uaua", "suau"]):
        trie.layers(signature)
    assert len(made) == 3 + 3 + 4
    monkeypatch.setattr(repair, "MOST_NODES", 2)
    again = repair.Trie()
    for signature in ("suau", "uaua", "suaU"):
        assert repair.end_of(again.layers(signature)[-1]) == repair.end_of(trie.layers(signature)[-1])


def test_runs_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        signature = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(1, 14)))
        whole = repair.Trie().layers(signature)
        cost, end = repair.end_of(whole[-1])
        cuts = sorted(rng.sample(range(1, len(signature)), min(len(signature) - 1, rng.randrange(3)))) if len(signature) > 1 else []
        runs = [signature[a:b] for a, b in zip([0, *cuts], [*cuts, len(signature)], strict=True)]
        solved = [[repair.Trie(s).layers(run) for s in range(4)] for run in runs]
        ways, total = repair.joined_runs([([c for x in four for c in x[-1].cost], [r for x in four for r in x[-1].rank]) for four in solved])
        got = [e for four, (a, b) in zip(solved, ways, strict=True) for e in repair.edits(four[a], b)[0]]
        assert total == cost and got == repair.edits(whole, end)[0] and ways[-1][1] == end


def test_repair_sql(spark, sf_dir, duck, agrees):
    got = queries.op12_conversation_repair(spark, sf_dir).toPandas()
    assert len(got)
    agrees(got, duck.execute(queries.ORACLE_SQL["op12_conversation_repair"]).df())


def test_repair_sql_of_odd_rows():
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows_of(), columns=COLUMNS).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = con.execute(queries.ORACLE_SQL["op12_conversation_repair"]).fetchall()
    assert sorted(got, key=str) == plain_repair(rows_of())
