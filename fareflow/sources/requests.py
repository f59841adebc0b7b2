"""Request intake: raw JSON bodies to typed rows.

Bodies are parsed once with ``from_json`` against fixed schemas (no
inference).  Scalars are read as text and cast with the PHP
casts of ``rules.py`` (``(int)`` / ``(float)``), so a malformed field falls
back to the reference's default instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import lenient_float, lenient_int

PASSENGER_FIELDS = ("full_name", "id_number", "seat_code", "gender", "birth_date", "phone_number", "id_image")
PASSENGER = T.StructType([T.StructField(f, T.StringType()) for f in PASSENGER_FIELDS])
PASSENGERS = T.ArrayType(PASSENGER)


REQUEST_FIELDS = ("user_id", "trip_id", "total_price", "payment_method")
#: One parse: scalars as text, the passenger list as JSON text of its own.
REQUEST = T.StructType([T.StructField(f, T.StringType()) for f in (*REQUEST_FIELDS, "passengers")])
IDENTIFIERS = ("identifier", "email", "phone", "phone_number")


def _number(body: Column, parsed: Column, name: str) -> Column:
    """Text of a numeric field; a JSON ``true`` counts as 1 (``false`` as 0), a string ``"true"`` does not."""
    is_true = (parsed == "true") & body.rlike(rf'"{name}"\s*:\s*true\b')
    return F.when(is_true, F.lit("1")).otherwise(parsed)


def parse_booking_requests(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """(request_id, received_at, body) -> typed request.  Defaults of
    the reference: ids 0, price 0, method ``'Cash'`` when absent (trimmed
    when present), passengers ``[]`` when absent or not a JSON array.  A price
    beyond the database's column is null (rejected later, never read as 0)."""
    keep = [c for c in raw.columns if c != body_col]
    raw = raw.select(*keep, F.col(body_col).alias("_body"), F.from_json(body_col, REQUEST).alias("_r"))
    body, method, pax_text = F.col("_body"), F.col("_r.payment_method"), F.trim("_r.passengers")
    passengers = F.when(pax_text.startswith("["), F.from_json(pax_text, PASSENGERS))
    return raw.select(
        *keep,
        lenient_int(_number(body, F.col("_r.user_id"), "user_id")).alias("user_id"),
        lenient_int(_number(body, F.col("_r.trip_id"), "trip_id")).alias("trip_id"),
        lenient_float(_number(body, F.col("_r.total_price"), "total_price")).alias("total_price"),
        F.when(method.isNull(), F.lit("Cash")).otherwise(F.trim(method)).alias("payment_method"),
        F.coalesce(passengers, F.array().cast(PASSENGERS)).alias("passengers"))


def parse_identifier(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """S3: the login identifier - first present of ``identifier``, ``email``,
    ``phone``, ``phone_number`` (PHP ``??`` chain), else ''."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in IDENTIFIERS])
    ident = F.coalesce(*[F.col(f"_r.{k}") for k in IDENTIFIERS], F.lit(""))
    return (raw.withColumn("_r", F.from_json(body_col, schema))
            .select(*[c for c in raw.columns if c != body_col], ident.alias("identifier")))
