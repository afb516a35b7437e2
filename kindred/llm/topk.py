"""Exact top-k search by elimination over a pivot table.

Vectors are made whole numbers. The table holds every vector's distance to each of many pivots; by the triangle inequality the largest gap between
a query's and a candidate's distances to one pivot is a lower bound of their distance, and so an upper bound of their inner product. Candidates are
evaluated in the order of that bound until it can't reach the k-th best score any more: what is left out provably doesn't belong.

The stated query set meets all rows block by block: both sides are cut into blocks by hash, a task holds one block of each, keeps the k best of
every query and the blocks' lists are merged by query. Block counts follow the table's size, block sizes don't.

All arithmetic on scores is on whole numbers: in floating point where every sum is certain to be exact, else in 64 bits, else in Python's integers. Components
beyond 64 bits are cut to the nearest number of 64 bits, and so are scores that the result column can't hold; scores that are cut alike tie.

Edge cases: a vector that is null, empty, or holds a null or a non-finite component takes no part, and neither does a row without an id; vectors of different lengths
have no inner product, so each length is searched on its own; ties go to the smaller id; a query meets every row but those with its own id; fewer than k candidates are all returned; repeated rows each count as candidates, and equal queries with one id are asked once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm import _vec as V

N_PIVOTS = 24
#: Rows of a block.
BLOCK_ROWS = 4096
#: Rows from which pivots are picked.
PIVOT_SAMPLE = 1024


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows far from one another: each next pivot is the row farthest from those so far."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(n, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def exact_kind(*arrays: np.ndarray):
    """The narrowest type in which all inner products of these whole numbers are exact."""
    most = max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)
    bound = most * most * max(a.shape[1] for a in arrays)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        high = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return high[np.lexsort((ids[high], -scores[high]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as the result holds them."""
    return np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def search_block(q_id, q, x_id, x, pivots, k, together: int = 64, step: int = 256):
    """The k best of block x for each query of block q, both of whole numbers: query, candidate and score. Also the number of pairs that were evaluated."""
    kind = exact_kind(q, x)
    q_near, x_near = (m.astype(np.float64) for m in (q, x))
    q_table, x_table = (pivot_table(m, pivots).astype(np.float32).T.copy() for m in (q_near, x_near))
    q_square, x_square = ((m**2).sum(1) for m in (q_near, x_near))
    q, x = (m.astype(kind) for m in (q, x))
    # Rounding of the table in single precision, as a share of the largest distance, and of the squares in double precision.
    size = max(q_square.max(initial=0.0), x_square.max(initial=0.0))
    margin = 1e-5 * (1 + max(float(q_table.max()), float(x_table.max()))) + 1e-7 * size**0.5 if q_table.size else 0
    slack = 1e-6 + 1e-12 * size
    out, evaluated = [], 0
    for at in range(0, len(q), together):
        lower = np.zeros((len(q_id[at : at + together]), len(x)), np.float32)
        for mine, theirs in zip(q_table[:, at : at + together], x_table, strict=True):
            np.maximum(lower, np.abs(mine[:, None] - theirs), out=lower)
        # Scores are whole: the floor of the bound is a bound.
        bounds = np.floor((q_square[at : at + together, None] + x_square - np.maximum(lower.astype(np.float64) - margin, 0) ** 2) / 2 + slack)
        bounds[q_id[at : at + together, None] == x_id] = -np.inf
        for i, upper in enumerate(bounds, at):
            left = int((upper > -np.inf).sum())
            part = np.argpartition(-upper, step)[:step] if left > step else np.flatnonzero(upper > -np.inf)
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            reach = float(upper[part].min()) if left > step else -np.inf
            rest = None
            while len(part):
                evaluated += len(part)
                got = x[part] @ q[i]
                got = as_long(got) if kind is object else np.rint(got).astype(np.int64)
                ids, scores = np.concatenate([ids, x_id[part]]), np.concatenate([scores, got])
                best = best_of(ids, scores, k)
                ids, scores = ids[best], scores[best]
                if rest is None:
                    # What is left, in the order of the bound, as far as it can still matter.
                    upper[part] = -np.inf
                    rest = np.flatnonzero((upper >= float(scores[-1])) & (upper > -np.inf)) if len(scores) == k else np.flatnonzero(upper > -np.inf)
                    rest = rest[np.argsort(-upper[rest])] if reach > -np.inf else rest[:0]
                if len(scores) == k:
                    rest = rest[: np.searchsorted(-upper[rest], -float(scores[-1]), "right")]
                part, rest = rest[: 4 * step], rest[4 * step :]
            out.append((np.full(len(ids), q_id[i]), ids, scores))
    return out, evaluated


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", n_pivots: int = N_PIVOTS) -> DataFrame:
    """query_id, rank (from 1), id and score of each query's k best."""
    spark = vectors.sparkSession
    V.tune(spark)
    src = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(is_query, F.lit(False)).alias("_q"), whole(F.col(vector_col), scale).alias("_v"))
    n, n_queries = src.agg(F.count("*"), F.coalesce(F.sum(F.col("_q").cast("long")), F.lit(0))).first()
    sample = src.orderBy(F.xxhash64("_id"), "_id", "_v").limit(PIVOT_SAMPLE).select("_v").collect()
    schema = f"query_id long, _query long, {id_col} long, score long"
    if not sample:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    widths: dict[int, list] = {}
    for row in sample:
        widths.setdefault(len(row[0]), []).append(row[0])
    # A length too rare for the sample gets pivots of its own in each block.
    pivots = {w: pick_pivots(np.array(rows, np.float64), n_pivots) for w, rows in widths.items()}
    x_blocks, q_blocks = -(-n // BLOCK_ROWS), max(1, -(-n_queries // BLOCK_ROWS))
    h = F.xxhash64("_id", F.lit("block"))
    data = src.select("_id", "_v", F.size("_v").alias("_w"), F.pmod(h, F.lit(x_blocks)).cast("int").alias("_xb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("_qb"))
    asked = src.where("_q").select("_id", "_v").distinct().select("_id", "_v", F.size("_v").alias("_w"), F.xxhash64("_v").alias("_query"), F.pmod(h, F.lit(q_blocks)).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))).alias("_xb"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "_query": [], id_col: [], "score": []}).astype("int64")
        mine, theirs = (np.stack(side["_v"].to_numpy()).astype(np.int64) for side in (q, x))
        known = pivots.get(mine.shape[1])
        known = pick_pivots(theirs[:PIVOT_SAMPLE].astype(np.float64), n_pivots) if known is None else known
        out, _ = search_block(q["_id"].to_numpy(), mine, x["_id"].to_numpy(), theirs, known, k)
        query, ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        vectors = np.repeat(q["_query"].to_numpy(), [len(c[0]) for c in out])
        return pd.DataFrame({"query_id": query, "_query": vectors, id_col: ids, "score": scores})

    found = asked.groupBy("_w", "_qb", "_xb").cogroup(data.groupBy("_w", "_qb", "_xb")).applyInPandas(run, schema)
    order = Window.partitionBy("query_id", "_query").orderBy(F.desc("score"), F.col(id_col))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", id_col, "score")
