"""Messages to columns and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txguard.functions.scalar import computed_once, iso_timestamp_or_null, whole_number
from txguard.schemas import TRANSACTION

# Fixed value: ISO-8601 with microseconds and offset.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def _parsed(value: str, schema: T.StructType) -> Column:
    """The fields as they are read: integers as any JSON value, times as text."""
    read = {T.LongType: T.VariantType(), T.IntegerType: T.VariantType(), T.TimestampType: T.StringType()}
    fields = [T.StructField(f.name, read.get(type(f.dataType), f.dataType)) for f in schema.fields]
    # Otherwise a filter on a decoded field would parse the text again, once per field it is made from.
    return computed_once(F.from_json(F.col(value).cast("string"), T.StructType(fields))).alias("data")


def _fields(schema: T.StructType) -> list[Column]:
    """The columns of ``schema`` from ``data``, by the conversions that the validator uses too."""

    def converted(field: T.StructField) -> Column:
        value = F.col("data")[field.name]
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            return whole_number(value, field.dataType.simpleString())
        return iso_timestamp_or_null(value) if isinstance(field.dataType, T.TimestampType) else value

    return [converted(f).alias(f.name) for f in schema.fields]


def decode(raw: DataFrame, schema: T.StructType = TRANSACTION, value: str = "value") -> DataFrame:
    """JSON text (or its bytes) to columns; a field that does not fit its type is null."""
    return raw.select(_parsed(value, schema)).select(*_fields(schema))


def split_decodable(
    raw: DataFrame, schema: T.StructType = TRANSACTION, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(columns of messages with at least one usable field, the other messages as they came)."""
    parsed = raw.select(*raw.columns, _parsed(value, schema))
    fields = _fields(schema)
    usable = reduce(Column.__or__, [f.isNotNull() for f in fields])
    return parsed.where(usable).select(*fields), parsed.where(~usable).drop("data")


def encode(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """All columns as JSON text, keyed by the id."""
    return df.select(F.col(key).cast("string").alias("key"), _text(df.columns).alias("value"))


def _text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"timestampFormat": _TIME})
