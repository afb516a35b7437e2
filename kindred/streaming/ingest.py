"""Extension: the cleaning steps over a stream of listings, and block sizes kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import blocking, identity


def cleaned_stream(listings: DataFrame) -> DataFrame:
    """Valid and repaired rows of a stream; the steps hold no state, so the batch operators serve as they are."""
    return identity.cleaned(listings)


def block_counts(listings: DataFrame, keys: tuple[str, ...], time: str = "listing_date", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Members of each block by time window; rows later than the watermark are left out, which bounds the state."""
    keyed = blocking.with_block_keys(listings.withWatermark(time, late), keys)
    return keyed.groupBy(F.window(time, window), *(f"k_{c}" for c in keys)).agg(F.count("*").alias("n"))
