"""Cleaning identifiers, and what they say about which rows are the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import vin as V
from kindred.operators.ranking import placed
from kindred.operators.staging import staged

#: First year of standardised numbers.
STANDARD_YEAR = 1981


def with_plausible_vin(df: DataFrame, vin: str = "Vin") -> DataFrame:
    normal = staged(df, **{vin: V.normalized(F.col(vin))})
    return staged(normal, **{vin: F.when(~V.implausible(F.col(vin)), F.col(vin))})


def is_legacy(vin: str = "Vin", year: str = "year"):
    """Older than the standard, with a number; a missing year is not old."""
    return F.coalesce((F.col(year) < STANDARD_YEAR) & F.col(vin).isNotNull(), F.lit(False))


def legacy_split(df: DataFrame, vin: str = "Vin", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """(legacy, rest): every row is in exactly one of them."""
    return df.where(is_legacy(vin, year)), df.where(~is_legacy(vin, year))


def with_status(df: DataFrame, vin: str = "Vin", status: str = "Vin_status") -> DataFrame:
    # One check digit a row: a number that needs repair has none of its own.
    shaky = F.coalesce(V.is_ambiguous(F.col(vin)), F.lit(False))
    checked = staged(df, _shaky=shaky, _read=F.when(shaky, V.repaired(F.col(vin))).otherwise(F.col(vin)))
    checked = staged(checked, _good=V.checksum_ok(F.col("_read")))
    state = V.status(F.col(vin), F.col("_shaky"), F.col("_good"), F.col("_good"))
    out = staged(checked, **{status: state, vin: F.when(F.col("_shaky") & F.col("_good"), F.col("_read")).otherwise(F.col(vin))})
    return out.drop("_read", "_good", "_shaky")


def cleaned(df: DataFrame, vin: str = "Vin", year: str = "year") -> DataFrame:
    """Rows with a valid or repaired number and a year that isn't legacy."""
    _, rest = legacy_split(with_plausible_vin(df, vin), vin, year)
    return with_status(rest, vin).where(F.col("Vin_status").isin("valid", "repaired"))


def training_records(df: DataFrame) -> DataFrame:
    """Without the columns that give the answer away."""
    return df.drop("Vin", "Vin_status").withColumnRenamed("listing_id", "id")


def truth_members(df: DataFrame, key: str = "Vin", id_col: str = "listing_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Long form of the truth map: (vin, id, pos) of every key with more than one row; pos counts from 1 in input order and duplicates stay. A key of very many rows is placed by several tasks."""
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("vin"), F.col(id_col).cast("string").alias("id"), *order)
    numbered = placed(keyed, ["vin"], list(order), total="n")
    return numbered.where("n > 1").select("vin", "id", F.col("pos").cast("int").alias("pos"), F.col("n").cast("long").alias("n"))


def truth_map(members: DataFrame) -> DataFrame:
    """vin, ids (in order), n: for the sink."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return members.groupBy("vin").agg(ids.alias("ids"), F.count("*").alias("n"))


def id_to_key(members: DataFrame) -> DataFrame:
    """(id, vin): an id under several keys belongs to the last of them in order."""
    return members.groupBy("id").agg(F.max("vin").alias("vin"))


def deduplicated(df: DataFrame, id_col: str, order: tuple[str, ...] = ("ord",), keep: str = "first") -> DataFrame:
    """One row an id: the first or the last in input order, or all of them (`keep` = 'all')."""
    from pyspark.sql import Window

    if keep == "all":
        return df
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy(*by))).where("_rn = 1").drop("_rn")
