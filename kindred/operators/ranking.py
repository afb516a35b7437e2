"""Global ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import written

#: Rows of one key that one task puts in order; keys with more are cut into ranges of their first order column.
HOT_ROWS = 200_000
#: Keys over HOT_ROWS that are sent to every task (a few MB); more of them are joined.
MOST_HOT = 50_000
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def seeded(seed: int, *columns: Column) -> Column:
    """A repeatable random key: any engine's md5 gives the same."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in columns)))


def uniform(key: Column, n: Column) -> Column:
    """A number from 0 to n - 1 from the first eight hex digits of a seeded key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % n


def ranked(df: DataFrame, order: list[str], bucket: Column, out: str = "rank", partition: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's rank (from 1) by `order`. `bucket` must follow the order and cut it finely: rows are ranked inside a bucket, and the rows of
    the earlier buckets, of which there is one count each, are added."""
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*partition, "_bucket").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(p).alias(f"_p_{p}") for p in partition), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition, "_bucket").orderBy(*order)))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for p in partition:
        same &= F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    joined = inside.join(starts, same)
    return joined.withColumn(out, F.col("_before") + F.col("_rn")).drop("_bucket", "_b", "_before", "_rn", *(f"_p_{p}" for p in partition))


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """The first hex digits of an md5 key: 4096 buckets of equal chance."""
    return F.substring(key, 1, digits)


def hot_keys(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Keys with more than `most` rows: their number, and the least and greatest value of the first order column."""
    ends = F.col(order[0]).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("_n"), F.min(ends).alias("_lo"), F.max(ends).alias("_hi")).where(F.col("_n") > most)


def placed(df: DataFrame, by: list[str], order: list[str], out: str = "pos", total: str | None = None, most: int | None = None) -> DataFrame:
    """df with each row's position (from 1) among the rows of its key in `order` and, if named, their number.

    Keys of up to `most` rows are one window each. A larger one is cut into ranges of its first order column, four for each `most` rows; rows are placed inside a range and the counts of the earlier ranges, one number each, are
    added. Where the first order column is no number, or has one value for all rows of the key, it stays one window, which spills."""
    most = HOT_ROWS if most is None else most
    hot = written(hot_keys(df, by, order, most), "hot-keys") if dict(df.dtypes)[order[0]].split("(")[0] in _NUMBERS else None
    n_hot = 0 if hot is None else hot.count()
    if not n_hot:
        mine = Window.partitionBy(*by)
        rows = df.withColumn(out, F.row_number().over(mine.orderBy(*order)))
        return rows.withColumn(total, F.count("*").over(mine)) if total else rows
    named = hot.select(*(F.col(c).alias(f"_h_{c}") for c in by), "_n", "_lo", "_hi")
    named = F.broadcast(named) if n_hot <= MOST_HOT else named
    same = lambda prefix: [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by]
    ranges = F.coalesce(F.width_bucket(F.col(order[0]).cast("double"), F.col("_lo"), F.col("_hi") + 1, F.ceil(F.col("_n") / most) * 4), F.lit(0))
    keyed = df.join(named, same("_h_"), "left").withColumn("_range", F.when(F.col("_n").isNotNull(), ranges).otherwise(0)).drop(*(f"_h_{c}" for c in by), "_lo", "_hi")
    # By key and range, not by key alone: a hot key's rows are spread over tasks.
    mine = Window.partitionBy(*by, "_range")
    inside = keyed.repartition(*by, "_range").withColumn("_rn", F.row_number().over(mine.orderBy(*order))).withColumn("_k", F.count("*").over(mine))
    counts = keyed.where("_n IS NOT NULL").groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(c).alias(f"_p_{c}") for c in by), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = inside.join(starts, [*same("_p_"), F.col("_range") == F.col("_r")], "left").withColumn(out, (F.coalesce("_before", F.lit(0)) + F.col("_rn")).cast("int"))
    joined = joined.withColumn(total, F.coalesce("_n", "_k")) if total else joined
    return joined.drop("_n", "_range", "_rn", "_k", "_r", "_before", *(f"_p_{c}" for c in by))
