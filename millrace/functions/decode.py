"""Messages to rows and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keeps the microseconds that the default JSON timestamp format drops.
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

CORRUPT = "_corrupt_record"

_ENVELOPE = "records array<struct<key: string, value: string>>"


def encode_json(*columns: str | Column) -> Column:
    """A JSON message of the given columns."""
    return F.to_json(F.struct(*columns), JSON_OPTIONS)


def _parsed(schema: T.StructType, value_col: str) -> Column:
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**JSON_OPTIONS, "columnNameOfCorruptRecord": CORRUPT}
    return F.from_json(F.col(value_col).cast("string"), with_corrupt, options)


def parse_json(messages: DataFrame, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """Add ``row`` (the fields) and ``_corrupt_record`` (the text, if it does not fit the schema)."""
    parsed = messages.withColumn("row", _parsed(schema, value_col))
    # A missing value is as undecodable as a broken one, and gives no struct at all.
    return parsed.withColumn(CORRUPT, F.when(F.col("row").isNull(), F.lit("")).otherwise(F.col(f"row.{CORRUPT}")))


def decode_json(messages: DataFrame, schema: T.StructType, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split messages into rows of the schema and undecodable raw values."""
    # Choosing within the generator parses each message once; a filter would be moved
    # below the projection and parse it again.
    decodable = F.filter(
        F.array(_parsed(schema, value_col)), lambda row: row.isNotNull() & row.getField(CORRUPT).isNull()
    )
    good = messages.select(F.inline(decodable)).drop(CORRUPT)
    bad = parse_json(messages, schema, value_col).filter(F.col(CORRUPT).isNotNull())
    return good, bad.select(F.col(CORRUPT).alias("raw_value"))


def parse_avro(messages: DataFrame, avro_schema: str, value_col: str = "value") -> DataFrame:
    """As ``parse_json`` for Avro messages; what does not fit is given in Base64. Spark raises
    its own error where its Avro package is missing."""
    from pyspark.sql.avro.functions import from_avro

    parsed = messages.withColumn("row", from_avro(F.col(value_col), avro_schema, {"mode": "PERMISSIVE"}))
    raw = F.coalesce(F.base64(F.col(value_col)), F.lit(""))
    return parsed.withColumn(CORRUPT, F.when(F.col("row").isNull(), raw))


def decode_avro(messages: DataFrame, avro_schema: str, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """Decode Avro messages; Spark raises its own error where its Avro package is missing."""
    from pyspark.sql.avro.functions import from_avro

    rows = messages.select(from_avro(F.col(value_col), avro_schema).alias("row"))
    return project(rows.select("row.*"), schema)


def encode_avro(columns: Column, avro_schema: str) -> Column:
    from pyspark.sql.avro.functions import to_avro

    return to_avro(columns, avro_schema)


def explode_envelope(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per record of a ``{"records": [{"key", "value"}, ...]}`` body."""
    records = F.from_json(F.col(body_col), _ENVELOPE)["records"]
    return bodies.select(F.explode(records).alias("record")).select("record.key", "record.value")


def projected(rows: DataFrame, schema: T.StructType) -> list[Column]:
    """The declared columns in declared order and type; those that rows lack are NULL."""
    present = set(rows.columns)
    return [
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]


def project(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with the declared columns only."""
    return rows.select(*projected(rows, schema))


def fill_defaults(rows: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Put declared defaults in place of NULLs; a list column gets a list of its default."""

    def filled(f: T.StructField) -> Column:
        default = F.lit(defaults[f.name])
        if isinstance(f.dataType, T.ArrayType):
            default = F.array(default)
        return F.coalesce(F.col(f"`{f.name}`"), default.cast(f.dataType)).alias(f.name)

    return rows.select(*(filled(f) if f.name in defaults else F.col(f"`{f.name}`") for f in rows.schema.fields))
