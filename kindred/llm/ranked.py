"""Ranked lexical search over a table of documents.

A posting says how often a term occurs in a document: (bucket, term, _row, doc_id, n, tf), n being the document's terms with repeats. Postings are a DataFrame whose
`bucket` is a hash of the term; items' terms carry the same bucket, and (bucket, term) joins the two. Each match is scored in 64-bit integers, the
scores of an item's terms in one document are summed, and a window keeps each item's k best documents.

Postings are made in one pass over the texts, of the wanted terms only while the items' terms are few enough to be sent to every task (`MOST_TERMS`), else of
all terms. They are dealt by document: all matches of a document then meet in the task that holds it, so summing needs no further exchange and
the window drops all but k documents of an item a task before anything is shuffled; a term that is in every document is spread over all tasks. More terms than MOST_TERMS
join by (bucket, term) instead, where Spark splits the rows of a common term, and sums are exchanged. Both ways give the same rows.

Edge cases: a null text has no terms and isn't counted; an item without terms, or with none that any document holds, has no rows; rows of one item_id are one item, with the terms of all
its rows; documents are rows, so repeated rows are ranked each on its own, and of equal scores the least doc_id comes first (a null one before all), then the row read first; texts of any length are
read whole; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm import _vec as V

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
BUCKETS = 256
#: Rows of (item, term) whose terms and weights are sent to every task: 20 MB at most of terms of usual length. More are joined.
MOST_TERMS = 200_000

#: Bytes that part terms: all of ASCII but digits and letters.
PARTS = np.ones(256, bool)
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, bucket, term): each term of an item once."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.distinct().withColumn("bucket", bucket_of(F.col("term")))


def term_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return V.Rolling(buf).spans(start, end), V.Rolling(buf, 1).spans(start, end)


def counted(column, known: tuple[np.ndarray, np.ndarray] | None):
    """Terms of each row, and as postings the row, the term's span (or its place in `known`, hashes sorted by the first one) and how often it occurs there."""
    buf, offsets = V.text_buffer(column)
    buf = _LOWER[buf]
    words = V.Words(buf, offsets, PARTS)
    n = np.bincount(words.row, minlength=len(offsets) - 1)
    first, second = term_hashes(buf, words.start, words.end)
    row, at = words.row, np.arange(len(words.row))
    if known is not None:
        place = np.minimum(np.searchsorted(known[0], first), max(len(known[0]) - 1, 0))
        # Equal first hashes of two wanted terms: none is lost, the second hash tells them apart.
        while len(known[0]):
            next_one = np.minimum(place + 1, len(known[0]) - 1)
            on = (known[0][place] == first) & (known[1][place] != second) & (known[0][next_one] == first) & (next_one > place)
            if not on.any():
                break
            place = np.where(on, next_one, place)
        hit = (known[0][place] == first) & (known[1][place] == second) if len(known[0]) else np.zeros(len(first), bool)
        row, at, first, second = row[hit], place[hit], first[hit], second[hit]
    order = np.lexsort((second, first, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    head = np.flatnonzero(new)
    tf = np.diff(np.append(head, len(order)))
    return n, row[order][head], at[order][head], tf, buf, words


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """bucket, term, _row, _id, n, tf of every document with a term, written once; of `terms` only, if given. One more row a document has no term: it is what counts documents."""
    V.tune(docs.sparkSession)
    known = names = None
    if terms is not None:
        buf, offsets = V.text_buffer(pa.array(terms, pa.string()))
        first, second = term_hashes(buf, offsets[:-1], offsets[1:])
        order = np.lexsort((second, first))
        known, names = (first[order], second[order]), pa.array(terms, pa.string()).take(pa.array(order))
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in V.chunks(batch, "_text"):
                n, row, at, tf, buf, words = counted(part.column("_text"), known)
                if names is None:
                    ends = np.concatenate([[0], np.cumsum(words.end[at] - words.start[at])]).astype(np.int64)
                    raw = buf[V.ragged(words.start[at], words.end[at] - words.start[at])]
                    term = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(raw.tobytes())).cast(pa.string())
                else:
                    term = names.take(pa.array(at))
                some = np.flatnonzero(n)
                row = np.concatenate([row, some])
                of = lambda c: part.column(c).take(pa.array(row))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([term, pa.nulls(len(some), pa.string())]), of("_row"), of("_id"), pa.array(n[row].astype(np.int64)), pa.array(np.concatenate([tf, np.zeros(len(some), int)]))],
                    names=["term", "_row", "_id", "n", "tf"],
                )

    made = rows.mapInArrow(run, f"term string, _row long, _id {kind}, n long, tf long")
    return V.written(made.select(bucket_of(F.col("term")).alias("bucket"), "*"), "postings")


def weight(df: Column, n_docs: int) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(F.log((F.lit(2.0) * n_docs + 2.0) / (df * 2.0 + 1.0)) * 1000.0).cast("long")


def match_score(w: Column, tf: Column, m: Column) -> Column:
    """The integer score of one match: w * ((10**9 tf) div (1000 tf + 8 m))."""
    made = F.struct((F.lit(1_000_000_000) * tf).alias("a"), (F.lit(1000) * tf + F.lit(8) * m).alias("b"))
    return w * F.call_function("div", made["a"], made["b"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents."""
    V.tune(docs.sparkSession)
    asked = V.written(item_terms(items, item_col, text_col), "item-terms")
    shipped = asked.limit(most_terms + 1).count() <= most_terms
    found = postings(docs, id_col, text_col, [r["term"] for r in asked.select("term").distinct().collect()] if shipped else None)
    total = found.where("term IS NULL").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    n_docs, n_terms = total["N"], max(total["L"], 1)
    met = found.where("term IS NOT NULL")
    weights = met.groupBy("term").agg(F.count("*").alias("df"))
    wanted = asked.join(weights, "term").select("item_id", "bucket", "term", weight(F.col("df"), n_docs).alias("w"))
    m = F.lit(10) + F.call_function("div", F.lit(90) * F.col("n") * F.lit(n_docs).cast("long"), F.lit(n_terms).cast("long"))
    met = met.select("bucket", "term", "_row", "_id", "tf", m.alias("m"))
    if shipped:
        met, wanted = met.repartition("_row"), F.broadcast(V.written(wanted, "weights"))
    scored = met.join(wanted, ["bucket", "term"]).select("item_id", "_row", "_id", match_score(F.col("w"), F.col("tf"), F.col("m")).alias("s"))
    sums = scored.groupBy("item_id", "_row").agg(F.first("_id").alias("doc_id"), F.sum("s").alias("score")).where("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "_row")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
