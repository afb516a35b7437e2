"""Column expressions that bring listing attributes to a common form. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as a regular expression's \\s has it.
BLANK = " \t\n\x0b\f\r"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() alone takes spaces only). No regular expression: one that looks for the end tries every place of a text."""
    return F.trim(c, F.lit(BLANK))


def text_of(c: Column, kind: str = "string") -> Column:
    """A value as text; doubles print like 2018.0 and 1234567.5, never with an exponent and with six decimals at most. Most doubles are printed so by themselves and need no decimal."""
    if kind in ("double", "float"):
        whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        part = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", "")
        if kind == "double":
            own = c.cast("string")
            plain = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)
            # A text of eight characters has a point, a digit before it and so six after it at most: most texts are made twice, for their length and as the result.
            short = F.when(plain & (F.length(own) <= 8), own).when(plain & (F.length(own) - F.instr(own, ".") <= 6), own)
            return short.when(c == F.floor(c), whole).otherwise(part)
        return F.when(c == F.floor(c), whole).otherwise(part)
    return c.cast("string")


def folded(c: Column, missing: str | None = None) -> Column:
    """Missing values are filled before lower-casing and stripping, so a literal 'Unknown' joins the filled ones."""
    c = c.cast("string")
    return stripped(F.lower(c if missing is None else F.coalesce(c, F.lit(missing))))


def without_point_zero(c: Column) -> Column:
    """Every '.0' goes, wherever it stands: 2018.0 becomes 2018 (and 2018.05 becomes 20185)."""
    return F.replace(c, F.lit(".0"), F.lit(""))


def block_key(c: Column, is_year: bool = False, kind: str = "string") -> Column:
    key = folded(text_of(c, kind), "unknown")
    return without_point_zero(key) if is_year else key


def rule_text(c: Column) -> Column:
    return folded(c, "")


def rule_year(c: Column, kind: str = "string") -> Column:
    return stripped(without_point_zero(F.coalesce(text_of(c, kind), F.lit("0"))))


def tolerant_double(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def clean_text(c: Column) -> Column:
    """Folded text; empty texts are null."""
    return F.nullif(folded(c), F.lit(""))


def zero_filled(c: Column) -> Column:
    number = tolerant_double(c)
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ids in string order."""
    return F.least(a, b), F.greatest(a, b)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def duration_seconds(c: Column) -> Column:
    """'3m 55s' as 235; null where minutes or seconds are missing."""
    shape = r"^\s*(\d+)m (\d+)s*\s*$"
    part = lambda i: F.regexp_extract(c, shape, i).try_cast("int")
    return part(1) * 60 + part(2)
