"""Computing a column once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added or replaced, each computed once a row.

    The optimizer copies a projected expression into every filter and projection above it. Expressions that look at the last step's value many times then
    grow by a factor a step. A generator of one row stops that, and still runs in generated code."""
    made = F.inline(F.array(F.struct(*(c.alias(f"_s_{name}") for name, c in columns.items()))))
    out = df.select("*", made)
    kept = [c for c in df.columns if c not in columns]
    if set(columns) <= set(df.columns):
        return out.select(*(F.col(f"_s_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))
    return out.select(*kept, *(F.col(f"_s_{name}").alias(name) for name in columns))
