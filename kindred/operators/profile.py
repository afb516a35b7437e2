"""Source profiling: null and distinct counts of every column.

One wide aggregate reads the table once and gives each column's filled values and a sketch of its different ones, of fixed size. What the sketch says decides how a column's exact count is made: the sets of columns with few different
values are kept and merged in a second wide aggregate; a column with many has a distinct of its own, which reads that column alone. No cell becomes a row. Sketches can be stored by batch and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DROP_ABOVE = 70.0
#: Different values, by the sketch, up to which a column's set is kept in one row.
SMALL_SET = 2_000
#: log2 of a sketch's buckets: an error of about 1 %.
SKETCH_SIZE = 13


def _value(df: DataFrame, c: str) -> Column:
    """A column's values as sketches take them; the two zeros of a number are one value."""
    kind = dict(df.dtypes)[c]
    if kind in ("double", "float"):
        return F.col(f"`{c}`") + F.lit(0.0)
    return F.col(f"`{c}`")


def _sketched(df: DataFrame, c: str) -> Column:
    return F.hll_sketch_agg(_value(df, c).cast("string"), F.lit(SKETCH_SIZE))


def sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """attr, n, filled and sketch of each column, from one pass: a row a column, to store by batch and merge."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(columns)), *(_sketched(df, c).alias(f"_s{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("attr"), "n", F.col(f"_f{i}").alias("filled"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)))
    return wide.select(F.inline(cells))


def merged(*batches: DataFrame) -> DataFrame:
    """The sketches of all batches as those of one table."""
    every = batches[0]
    for more in batches[1:]:
        every = every.unionByName(more)
    return every.groupBy("attr").agg(F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketched: DataFrame) -> DataFrame:
    """attr, n, filled and n_uniq as the sketches estimate it."""
    return sketched.select("attr", "n", "filled", F.when(F.col("filled") > 0, F.hll_sketch_estimate("sketch")).otherwise(0).alias("n_uniq"))


def _exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """attr, n, filled and n_uniq, exact: the sketches' row comes to the driver and says how each column is counted."""
    spark = df.sparkSession
    guess = {r["attr"]: r for r in estimated(sketches(df, columns)).collect()}
    few = [c for c in columns if guess[c]["n_uniq"] <= SMALL_SET]
    out = spark.createDataFrame([(c, guess[c]["n"], guess[c]["filled"]) for c in columns], "attr string, n long, filled long")
    counts = None
    if few:
        wide = df.agg(*(F.size(F.collect_set(_value(df, c))).cast("long").alias(f"_u{i}") for i, c in enumerate(few)))
        counts = wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(f"_u{i}").alias("n_uniq")) for i, c in enumerate(few)))))
    for c in columns:
        if c not in few:
            one = df.select(_value(df, c).alias("v")).where("v IS NOT NULL").distinct().agg(F.count("*").alias("n_uniq")).select(F.lit(c).alias("attr"), "n_uniq")
            counts = one if counts is None else counts.unionByName(one)
    return out.join(counts, "attr")


def report(counted: DataFrame) -> DataFrame:
    """null_pct (2 digits), uniq_pct (4 digits), n_uniq and drop_flag (null_pct above 70) of attr, n, filled and n_uniq, most nulls first."""
    share = lambda part, digits: F.round(F.try_divide(part * F.lit(100.0), F.col("n")), digits)
    rows = counted.select("attr", share(F.col("n") - F.col("filled"), 2).alias("null_pct"), share(F.col("n_uniq"), 4).alias("uniq_pct"), F.col("n_uniq").cast("long").alias("n_uniq"))
    return rows.withColumn("drop_flag", F.coalesce(F.col("null_pct") > DROP_ABOVE, F.lit(False))).orderBy(F.desc("null_pct"), "attr")


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """The report of each column. Distinct counts are exact, with nulls left out; `approximate` takes the sketches' word. An empty table has null percentages."""
    columns = columns or df.columns
    return report(estimated(sketches(df, columns)) if approximate else _exact(df, columns))


def columns_to_drop(report: DataFrame) -> list[str]:
    """Attributes with too many nulls: one row a column comes to the driver."""
    return [r["attr"] for r in report.where("drop_flag").select("attr").collect()]
