"""Connected components of an edge table by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import _vec as V


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour v of each node u, as (c, m). It is written, so that the join with it has an exchange of its own on both sides and Spark can split a hub's rows."""
    return V.written(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "least")


def _large_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    return _both(edges).join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.least("c", "m").alias("v"))


def _small_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    joined = _down(edges).join(low, F.col("u") == F.col("c")).where("v <> m")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("x").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 OR (o > 0 AND i > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) but the roots: a root is the least node of its component."""
    now = V.written(_down(edges.where("u <> v")).distinct(), "edges")
    while True:
        low = _least(_both(now))
        wide = V.written(_large_star(now, low).distinct(), "stars")
        V.discard(now, low)
        low = _least(_down(wide))
        now = V.written(_small_star(wide, low).distinct(), "stars")
        V.discard(wide, low)
        if _are_stars(now):
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._written = now._written
            return out
