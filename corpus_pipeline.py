"""The corpus pipeline: quality rules, line deduplication, near-duplicate removal, source mixing and packing, one after the other over `documents`.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it returns is written as Parquet and read again for the next, which
deletes it when it is written itself. All stages but the last return the columns of `documents`, with n_chars brought up to date where the text changed.

Edge cases in every stage: further columns pass through whatever their names are; texts of any length are worked on whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import _vec, linedup, mixing, neardup, packing, quality, queries


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, null and empty texts with them (they have no words); repeated rows are judged alike."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or is one edit or a tenth of its words away from, go; every document stays, with its other lines.
    A null text stays null; of repeated rows all keep the same lines; ties in the id are broken by the text's hash."""
    return _counted(linedup.without_duplicates(docs, words_an_edit=linedup.WORDS_AN_EDIT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id, and one row of it where rows repeat; rows with a null text all stay."""
    return neardup.deduplicated(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that the sources' words meet their targets; a null source is a source, a null text has no words, repeated rows are mixed one by one."""
    return mixing.mixed(docs)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token windows, with their ids; a null text is packed as an empty one, repeated rows one by one."""
    return packing.pack(docs, queries.tokenizer_file(), queries.END_ID, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("token_packing", token_packing),
]

#: Near-duplicate classes and balanced samples can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, _vec.written(stage(spark, docs, sf_dir), name)
        _vec.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
