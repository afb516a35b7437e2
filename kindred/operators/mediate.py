"""Mapping sources to the mediated schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mediated schema and what each source calls its columns.
MEDIATED = (
    "Vin", "listing_id", "make", "model", "year", "price", "mileage", "fuel_type", "transmission", "body_type", "drive", "condition", "color",
    "engine_cylinders", "latitude", "longitude", "description", "listing_date", "source",
)
INFORMAL = {
    "Vin": "VIN", "listing_id": "id", "make": "manufacturer", "model": "model", "year": "year", "price": "price", "mileage": "odometer", "fuel_type": "fuel",
    "transmission": "transmission", "body_type": "type", "drive": "drive", "condition": "condition", "color": "paint_color", "engine_cylinders": "cylinders",
    "latitude": "lat", "longitude": "long", "description": "description", "listing_date": "posting_date",
}
STRUCTURED = {
    "Vin": "vin", "listing_id": "listing_id", "make": "make_name", "model": "model_name", "year": "year", "price": "price", "mileage": "mileage", "fuel_type": "fuel_type",
    "transmission": "transmission_display", "body_type": "body_type", "drive": "wheel_system_display", "condition": "is_new", "color": "exterior_color",
    "engine_cylinders": "engine_cylinders", "latitude": "latitude", "longitude": "longitude", "description": "description", "listing_date": "listed_date",
}
INFORMAL_SOURCE, STRUCTURED_SOURCE = "craigslist", "us_used_cars"


def utc_time(c: Column) -> Column:
    """A time stamp in the session's zone (UTC), of dates and ISO times with -0500, -05:00, Z or no offset; null where the text is none. A cast tells by itself, where a pattern that doesn't fit costs an exception a row."""
    return c.try_cast("timestamp")


def new_or_used(c: Column) -> Column:
    return F.when(c, "new").when(~c, "used")


def mapped(df: DataFrame, names: dict[str, str], source: str, schema: tuple[str, ...] = MEDIATED, convert: dict | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """df's columns under their mediated names, in the schema's order, with the source's name; `convert` has functions by mediated name."""
    convert = convert or {}
    value = lambda c: F.lit(source) if c == "source" else convert.get(c, lambda x: x)(F.col(names[c]))
    return df.select(*(value(c).alias(c) for c in schema), *carry)


def informal(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return mapped(df, INFORMAL, INFORMAL_SOURCE, convert={"listing_date": utc_time, "listing_id": lambda c: c.cast("string")}, carry=carry)


def structured(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return mapped(df, STRUCTURED, STRUCTURED_SOURCE, convert={"listing_date": utc_time, "condition": new_or_used, "listing_id": lambda c: c.cast("string")}, carry=carry)


def integrated(*sources: DataFrame) -> DataFrame:
    """All rows of all sources."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out
