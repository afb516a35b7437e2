"""Ranked lexical search against a plain version."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CLASHING, SCHEMA, texts

from kindred.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k):
    docs = [(doc, collections.Counter(terms(t))) for doc, t in rows if terms(t)]
    total, df = sum(sum(c.values()) for _, c in docs), collections.Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in asked.items():
        scores = []
        for doc, c in docs:
            m = 10 + 90 * sum(c.values()) * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, doc is not None, doc or 0))
        out += [(item, rank, doc if some else None, -s) for rank, (s, some, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, texts()[0][:300]), (2, None), (3, ""), (4, "zzzzzzzzzz"), (5, "THE one two, Spam; spam"), (5, "changed\x00words ñANDÚ É"), (6, texts()[3].upper()), (6, texts()[3]), (None, "two words one")]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts())) + [(3, texts()[3]), (3, texts()[3]), (None, "one two"), (None, None), (7, "a different text of one id"), (99, "ab\x00cd²½Ⅷ")]
    return [(doc, t, "en", "s", 0) for doc, t in out]


@pytest.mark.parametrize(("most", "k"), [(ranked.MOST_TERMS, 10), (3, 10), (ranked.MOST_TERMS, 2)])
def test_search(spark, rows, most, k):
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in [*CLASHING, "term", "bucket", "item_id"])).repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").select("*", F.lit(1).alias("doc_id"), F.lit("x").alias("term"))
    got = ranked.search(docs, items, k, most_terms=most).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == plain_search([r[:2] for r in rows], ITEMS, k)
    assert ranked.search(docs.where("false"), items).count() == 0 and ranked.search(docs, items.where("false")).count() == 0


def test_terms_with_equal_first_hashes():
    column = pa.array(["alpha beta alpha", None, "gamma"])
    buf, offsets = ranked.V.text_buffer(pa.array(["alpha", "beta", "gamma"]))
    first, second = ranked.term_hashes(buf, offsets[:-1], offsets[1:])
    # Three entries of one first hash stand in front of the right one.
    at = np.full(4, first[0])
    known = np.concatenate([at, first[2:]]), np.concatenate([[second[0] - np.uint64(3), second[0] - np.uint64(2), second[0] - np.uint64(1), second[0]], second[2:]]).astype(np.uint64)
    order = np.lexsort((known[1], known[0]))
    n, row, place, tf, *_ = ranked.counted(column, (known[0][order], known[1][order]))
    assert n.tolist() == [3, 0, 1] and row.tolist() == [0, 2] and tf.tolist() == [2, 1] and known[1][order][place[0]] == second[0]


def test_search_sql(spark, sf_dir, duck, agrees):
    got = queries.op11_ranked_search(spark, sf_dir).toPandas()
    assert len(got)
    agrees(got, duck.execute(queries.ORACLE_SQL["op11_ranked_search"]).df())


def test_search_sql_of_odd_rows(rows, agrees):
    con = duckdb.connect()
    pd = pytest.importorskip("pandas")
    documents, benchmark = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"})  # noqa: F841
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    got = con.execute(queries.ORACLE_SQL["op11_ranked_search"]).fetchall()
    assert sorted(got, key=str) == plain_search([r[:2] for r in rows], ITEMS, 10)
