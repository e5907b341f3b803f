"""Column classes (what to measure) and type families (what may be compared).

The two mappings differ on purpose: a TIME column has no date part, so it gets no
temporal statistics, yet it may be compared with other temporal columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

NUMERIC, TEMPORAL, BOOLEAN, STRING, NESTED, OTHER = (
    "numeric",
    "temporal",
    "boolean",
    "string",
    "nested",
    "other",
)

_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_STRING = (T.StringType, T.CharType, T.VarcharType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME = getattr(T, "TimeType", ())


def column_class(data_type: T.DataType) -> str:
    """The class that decides which statistics a column gets."""
    if isinstance(data_type, _NESTED):
        return NESTED
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, _TEMPORAL):
        return TEMPORAL
    if isinstance(data_type, _STRING):
        return STRING
    return OTHER


def type_family(data_type: T.DataType) -> str:
    """The family within which two columns may be compared."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, _STRING):
        return "text"
    if isinstance(data_type, _TEMPORAL) or (_TIME and isinstance(data_type, _TIME)):
        return "temporal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL) or (
        isinstance(data_type, T.DecimalType) and data_type.scale == 0
    )


def common_key_type(left: T.DataType, right: T.DataType) -> str | None:
    """A type both sides of a key comparison are cast to before they are grouped.

    Casting first keeps the grouping and the join on one partitioning. ``None``
    means the types are already equal.
    """
    if left == right:
        return None
    if type_family(left) == "numeric":
        if isinstance(left, _INTEGRAL) and isinstance(right, _INTEGRAL):
            return "bigint"
        if is_floating(left) or is_floating(right):
            return "double"
        scale = max(getattr(left, "scale", 0), getattr(right, "scale", 0))
        return f"decimal(38,{scale})"
    if type_family(left) == "temporal":
        if any(isinstance(t, T.TimestampType) for t in (left, right)):
            return "timestamp"
        return "timestamp_ntz"
    return "string"
