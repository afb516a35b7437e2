"""Rule-based linkage: features, weighted score, decision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions.normalize import rule_text, rule_year, tolerant_double

FEATURES = ("f_make", "f_model", "f_year", "f_price", "f_mileage")
# Weights of the features, gate on block sizes and thresholds.
WEIGHTS = (2.0, 4.0, 2.0, 1.0, 1.0)
BLOCK_LIMIT = 200
THRESHOLD = 0.85
SWEEP = (0.70, 0.75, 0.80, 0.85, 0.90)


def rule_records(df: DataFrame) -> DataFrame:
    """Attributes as the rules compare them."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {"r_make": rule_text(F.col("make")), "r_model": rule_text(F.col("model")), "r_year": rule_year(F.col("year"), kinds["year"]), "r_price": tolerant_double(F.col("price")), "r_mileage": tolerant_double(F.col("mileage"))}
    )


COMPARED = ("r_make", "r_model", "r_year", "r_price", "r_mileage")


def features(pairs: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """The five features of pairs that carry COMPARED of both sides; `models` may name the pairs (x, y) of models that can occur."""
    scored = S.by_dictionary(pairs, "r_model_1", "r_model_2", "_jw", S.jaro_winkler_all, values=models)
    return scored.withColumns(
        {
            "f_make": S.at_least(S.levenshtein_similarity(F.col("r_make_1"), F.col("r_make_2"))), "f_model": S.at_least(F.col("_jw")), "f_year": S.exact(F.col("r_year_1"), F.col("r_year_2")),
            "f_price": S.linear(F.col("r_price_1"), F.col("r_price_2")), "f_mileage": S.linear(F.col("r_mileage_1"), F.col("r_mileage_2")),
        }
    ).drop("_jw")


def same_entity(a: Column, b: Column) -> Column:
    """1 where both identifiers are known and equal, else 0."""
    return F.coalesce(a == b, F.lit(False)).cast("int")


def weighted(names: tuple[str, ...] = FEATURES, weights: tuple[float, ...] = WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, w in zip(names, weights, strict=True):
        total = total + F.col(name) * w
    return total / sum(weights)


def decided(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def cell_scores(a: pa.Table, b: pa.Table) -> Callable[[slice, slice], np.ndarray]:
    """`weighted` of `features` of stretches of rows (COMPARED) of both tables, each with each, added up in the same order."""
    texts = S.Texts(a, b, COMPARED[:3])
    same = lambda x, y: np.array([[float(v is not None and v == w) for w in y] for v in x])
    cut = lambda score: lambda x, y: (S.in_table(x, y, score) >= S.CUT).astype(float)
    base = 0.0
    for c, score, w in zip(COMPARED[:3], (cut(S.levenshtein_all), cut(S.jaro_winkler_all), same), WEIGHTS[:3], strict=True):
        base = base + texts.by(c, score) * w
    numbers = [(S.numbers(a.column(c)), S.numbers(b.column(c)), w) for c, w in zip(COMPARED[3:], WEIGHTS[3:], strict=True)]

    def score(i: slice, j: slice) -> np.ndarray:
        out = texts.spread(base, i, j)
        for (x, no_x), (y, no_y), w in numbers:
            with np.errstate(invalid="ignore", over="ignore"):
                alike = np.subtract.outer(x[i], y[j])
                np.abs(alike, out=alike)
            alike /= 2 * 0.1
            np.subtract(1, alike, out=alike)
            np.maximum(alike, 0.0, out=alike)
            alike[no_x[i]] = 0.0
            alike[:, no_y[j]] = 0.0
            if w != 1:
                alike *= w
            out += alike
        out /= sum(WEIGHTS)
        return out

    return score
