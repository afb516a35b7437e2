"""Listings made of the benchmark tables lineitem and part, with injected dirt; the same rows in Spark and, as SQL, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.operators import mediate

#: Columns both engines compute alike. `m` decides which dirt a row gets.
_ROW = (
    ("ord", "l_orderkey * 10 + l_linenumber"),
    ("row_key", "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, CAST(l_shipdate AS DATE)))"),
    ("m", "(l_orderkey * 7 + l_partkey * 3 + l_suppkey + l_linenumber) % 40"),
    ("d", "lpad(CAST((p_partkey * 7919) % 100000000 AS STRING), 8, '0')"),
)
_DIGITS = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2)))
#: 225 is the weighted sum of the first eight characters, 1HGCM826.
_CHECK = f"CASE WHEN (225 + {_DIGITS}) % 11 = 10 THEN 'X' ELSE CAST((225 + {_DIGITS}) % 11 AS STRING) END"
_VIN = """CASE m WHEN 0 THEN concat(lower(substr(v, 1, 5)), '-', substr(v, 6)) WHEN 1 THEN replace(v, '0', 'O')
 WHEN 2 THEN concat(substr(v, 1, 8), CASE WHEN substr(v, 9, 1) = '5' THEN '6' ELSE '5' END, d) WHEN 3 THEN substr(v, 1, 16) WHEN 4 THEN 'None'
 WHEN 5 THEN NULL WHEN 6 THEN '11111111111111111' ELSE v END"""
_LISTING = (
    ("vin", _VIN),
    ("id", "CAST(ord AS STRING)"),
    ("make", "CASE m WHEN 9 THEN concat(TAB, upper(p_brand), ' ') WHEN 10 THEN NULL WHEN 11 THEN 'Unknown' ELSE p_brand END"),
    ("model", "CASE WHEN m = 12 THEN NULL ELSE p_name END"),
    ("year", "CASE m WHEN 7 THEN CAST(1975 AS DOUBLE) WHEN 8 THEN NULL ELSE CAST(year(l_shipdate) AS DOUBLE) END"),
    ("price", "CASE WHEN m = 13 THEN NULL ELSE l_extendedprice END"),
    ("mileage", "CASE WHEN m = 14 THEN NULL ELSE l_quantity END"),
    ("fuel", "CASE WHEN m = 15 THEN NULL ELSE p_type END"),
    ("transmission", "l_returnflag"),
    ("body", "CASE WHEN m < 30 THEN NULL ELSE l_linestatus END"),
    ("drive", "CAST(p_size AS STRING)"),
    ("is_new", "CASE m % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END"),
    ("color", "concat(l_returnflag, l_linestatus)"),
    ("cylinders", "CASE WHEN m < 36 THEN NULL ELSE CAST(l_linenumber AS STRING) END"),
    ("lat", "l_discount"),
    ("long", "l_tax"),
    ("description", "concat(p_name, ' ', p_type)"),
    ("posted", "CASE WHEN m = 16 THEN 'not a date' ELSE concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T12:31:18-0500') END"),
    ("listed", "CASE WHEN m = 16 THEN 'not a date' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END"),
    ("informal", "l_linestatus = 'O'"),
)


def input_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord of every lineitem, without the attributes of its part."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{dict(_ROW)['ord']} AS ord")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a lineitem, with ord and row_key (the input order) and the attributes of both sources under neutral names."""
    lines, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part"))
    # What a line alone says is computed before the join, so that its shuffle carries no column that only the row key reads, and the key's bytes instead of its digits.
    lines = lines.selectExpr("*", *(f"unhex({e}) AS _key" if n == "row_key" else f"{e} AS {n}" for n, e in _ROW if n != "d"))
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey)
    rows = joined.selectExpr("*", "lower(hex(_key)) AS row_key", f"{dict(_ROW)['d']} AS d").selectExpr("*", f"concat('1HGCM826', {_CHECK}, d) AS v")
    return rows.selectExpr("ord", "row_key", *(f"{e.replace('TAB', 'char(9)')} AS {n}" for n, e in _LISTING))


def _named(rows: DataFrame, names: dict[str, str], neutral: dict[str, str]) -> DataFrame:
    return rows.selectExpr(*(f"{neutral[k]} AS `{c}`" for k, c in names.items()), "ord", "row_key")


_NEUTRAL = {
    "Vin": "vin", "listing_id": "id", "make": "make", "model": "model", "year": "year", "price": "price", "mileage": "mileage", "fuel_type": "fuel", "transmission": "transmission",
    "body_type": "body", "drive": "drive", "color": "color", "engine_cylinders": "cylinders", "latitude": "lat", "longitude": "long", "description": "description",
}


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The informal and the structured source under their own column names."""
    rows = raw(spark, sf_dir)
    one = _named(rows.where("informal"), mediate.INFORMAL, _NEUTRAL | {"condition": "CASE WHEN is_new THEN 'new' END", "listing_date": "posted"})
    two = _named(rows.where("NOT informal"), mediate.STRUCTURED, _NEUTRAL | {"condition": "is_new", "listing_date": "listed"})
    return one, two


def mediated(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    one, two = sources(spark, sf_dir)
    order = ("ord", "row_key")
    return mediate.integrated(mediate.informal(one, order), mediate.structured(two, order))


def _duck(e: str) -> str:
    return e.replace(" AS STRING)", " AS VARCHAR)").replace("TAB", "chr(9)")


#: The mediated listings as common table expressions.
MEDIATED_SQL = f"""
base AS (SELECT *, {", ".join(f"{_duck(e)} AS {n}" for n, e in _ROW)} FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (SELECT *, concat('1HGCM826', {_duck(_CHECK)}, d) AS v FROM base),
listing AS (SELECT ord, row_key, {", ".join(f"{_duck(e)} AS {n}" for n, e in _LISTING)} FROM numbered),
mediated AS (SELECT vin AS raw_vin, id AS listing_id, make, model, year, price, mileage, fuel AS fuel_type, transmission, body AS body_type, drive,
  CASE WHEN informal THEN CASE WHEN is_new THEN 'new' END ELSE CASE WHEN is_new THEN 'new' WHEN NOT is_new THEN 'used' END END AS condition,
  color, cylinders AS engine_cylinders, lat AS latitude, long AS longitude, description,
  CASE WHEN posted = 'not a date' THEN NULL ELSE strftime(CAST(listed AS TIMESTAMP) + CASE WHEN informal THEN INTERVAL 63078 SECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%d %H:%M:%S') END AS listing_date,
  CASE WHEN informal THEN 'craigslist' ELSE 'us_used_cars' END AS source, ord, row_key FROM listing)"""
