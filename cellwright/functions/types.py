"""Type classes used by the operators (decided from the schema, never from data)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Named target types of CONVERT_TYPE (and VALIDATE_TYPES, which adds float32).
TARGET_TYPES = {
    "str": T.StringType(), "string": T.StringType(),
    "int": T.LongType(), "int64": T.LongType(), "int32": T.IntegerType(),
    "float": T.DoubleType(), "float64": T.DoubleType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampType(),
}
VALIDATE_TYPES = dict(TARGET_TYPES, float32=T.FloatType())


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC)


def is_integral(dt) -> bool:
    return isinstance(dt, INTEGRAL)


def is_string(dt) -> bool:
    return isinstance(dt, T.StringType)


def is_date(dt) -> bool:
    return isinstance(dt, DATES)


def kind_of(dt) -> str:
    if is_numeric(dt):
        return "numeric"
    if is_string(dt):
        return "string"
    if is_date(dt):
        return "date"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def dtypes(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def reference_dtype_name(dt) -> str:
    """Dtype name as the reference reports it in its schema report."""
    names = {
        T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64",
        T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "String",
        T.BooleanType: "Boolean", T.DateType: "Date", T.TimestampType: "Datetime",
        T.TimestampNTZType: "Datetime", T.DecimalType: "Decimal",
    }
    for cls, name in names.items():
        if isinstance(dt, cls):
            return name
    return dt.simpleString()
