"""Vehicle identification numbers: normal form, plausibility, check digit, repair and status, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders, letter values, weights and repairs of the identification number's standard.
PLACEHOLDERS = ("NONE", "NAN", "NULL", "UNKNOWN", "EMPTY", "0", "X", "ANY")
LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VALUES = "12345678123457923456789"
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
AMBIGUOUS, REPAIRED = "IOQ", "100"
CHECK_DIGITS = "0123456789X"


def normalized(vin: Column) -> Column:
    """Upper case, letters and digits only; placeholders are null."""
    v = F.regexp_replace(F.upper(vin), "[^A-Z0-9]", "")
    return F.when(~v.isin(*PLACEHOLDERS), v)


def implausible(vin: Column) -> Column:
    """Null, empty, fewer than four different characters, XXX, a start of 000, only digits or only letters."""
    few = F.size(F.array_distinct(F.split(vin, ""))) < 4
    bad = (vin == "") | few | F.contains(vin, F.lit("XXX")) | F.startswith(vin, F.lit("000")) | vin.rlike("^[0-9]+$") | vin.rlike("^[A-Z]+$")
    return F.coalesce(bad, F.lit(True))


def plausible(vin: Column) -> Column:
    """The normal form, null where it is implausible."""
    v = normalized(vin)
    return F.when(~implausible(v), v)


def _code_values() -> list[int]:
    """The value of each character from 0 to Z by its code; 0 where the standard has none."""
    known = dict(zip(LETTERS, map(int, VALUES), strict=True)) | {str(d): d for d in range(10)}
    return [known.get(chr(c), 0) for c in range(ord("0"), ord("Z") + 1)]


def checksum_ok(vin: Column) -> Column:
    """The ninth character equals the check digit over all seventeen. Values are looked up by a character's code in one constant array: no text is parsed or made."""
    values = F.array(*map(F.lit, _code_values()))
    total = sum((F.get(values, F.ascii(F.substring(vin, i + 1, 1)) - ord("0")) * w for i, w in enumerate(WEIGHTS) if w), F.lit(0))
    check = F.substring(F.lit(CHECK_DIGITS), total % 11 + 1, F.lit(1))
    shaped = (F.length(vin) == 17) & vin.rlike(f"^[0-9{LETTERS}]{{17}}$")
    return F.coalesce(F.when(shaped, F.substring(vin, 9, 1) == check), F.lit(False))


def repaired(vin: Column) -> Column:
    return F.translate(vin, AMBIGUOUS, REPAIRED)


def is_ambiguous(vin: Column) -> Column:
    return (F.length(vin) == 17) & vin.rlike(f"[{AMBIGUOUS}]")


def status(vin: Column, ambiguous: Column | None = None, good: Column | None = None, mended: Column | None = None) -> Column:
    """dropped, repaired, valid or ambiguous. Whoever repairs to a known good number passes the check digit anyway, so no list of those is needed.

    The parts (is_ambiguous, checksum_ok, checksum_ok of the repaired number) may be given where they are columns already."""
    ambiguous = is_ambiguous(vin) if ambiguous is None else ambiguous
    good = checksum_ok(vin) if good is None else good
    mended = checksum_ok(repaired(vin)) if mended is None else mended
    return (
        F.when(vin.isNull(), "dropped")
        .when(ambiguous, F.when(mended, "repaired").otherwise("dropped"))
        .when(F.length(vin) == 17, F.when(good, "valid").otherwise("dropped"))
        .otherwise("ambiguous")
    )


def resolved(vin: Column) -> Column:
    """The repaired number where the repair holds, the number itself otherwise."""
    return F.when(is_ambiguous(vin) & checksum_ok(repaired(vin)), repaired(vin)).otherwise(vin)
