"""Attribute types, their Spark types and the coercion of values."""

from __future__ import annotations

import datetime as dt
from enum import IntEnum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 1 << 20


class ValueType(IntEnum):
    # fixed values: the type ids of the data model
    STRING = 20
    REF = 21
    LONG = 22
    KEYWORD = 23
    BOOLEAN = 24
    INSTANT = 25
    BYTES = 26
    FLOAT = 27
    BLOB = 28


#: The log's column that holds a type's values.
COLUMN = {
    ValueType.STRING: "v_str", ValueType.KEYWORD: "v_str", ValueType.LONG: "v_long", ValueType.REF: "v_long", ValueType.INSTANT: "v_long",
    ValueType.BOOLEAN: "v_bool", ValueType.FLOAT: "v_double", ValueType.BYTES: "v_bin", ValueType.BLOB: "v_bin",
}
COLUMNS = {"v_long": "bigint", "v_double": "double", "v_str": "string", "v_bool": "boolean", "v_bin": "binary"}
SPARK = {
    ValueType.STRING: "string", ValueType.KEYWORD: "string", ValueType.LONG: "bigint", ValueType.REF: "bigint", ValueType.INSTANT: "timestamp",
    ValueType.BOOLEAN: "boolean", ValueType.FLOAT: "double", ValueType.BYTES: "binary", ValueType.BLOB: "binary",
}


def micros(value: Any) -> int:
    """An instant as microseconds since 1970: from an int, an ISO string or a datetime."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime):
        value = value.replace(tzinfo=value.tzinfo or dt.UTC)
        return (value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"not an instant: {value!r}")
    return value


def coerce(value: Any, kind: ValueType) -> Any:
    """value as the log stores it. Integers become booleans (0 and 1), references and floats where
    those are asked for; other mismatches raise TypeError."""
    if kind in (ValueType.STRING, ValueType.KEYWORD):
        if isinstance(value, str) and len(value.encode()) <= MAX_BYTES:
            return value
    elif kind in (ValueType.LONG, ValueType.REF):
        if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63:
            return value
    elif kind == ValueType.BOOLEAN:
        if isinstance(value, bool) or value in (0, 1) and isinstance(value, int):
            return bool(value)
    elif kind == ValueType.INSTANT:
        return micros(value)
    elif kind == ValueType.FLOAT:
        if isinstance(value, int | float) and not isinstance(value, bool):
            return float(value)
    elif isinstance(value, bytes | bytearray) and (kind == ValueType.BLOB or len(value) <= MAX_BYTES):
        return bytes(value)
    raise TypeError(f"{value!r} is no {kind.name}")


def literal(value: Any, kind: ValueType | None) -> Column:
    """A constant to compare with values of a type, in its native Spark type. A comparison may be
    with any number for numeric types, so that `size > 4.5` works."""
    if kind is None:
        return F.lit(value)
    if kind == ValueType.INSTANT:
        return F.timestamp_micros(F.lit(micros(value)))
    if kind in (ValueType.LONG, ValueType.REF, ValueType.FLOAT) and isinstance(value, int | float) and not isinstance(value, bool):
        return F.lit(value)
    return F.lit(coerce(value, kind))


def fits(value: Any, kind: ValueType) -> bool:
    try:
        literal(value, kind)
    except (TypeError, ValueError):
        return False
    return True


def rendered(value: Column, kind: ValueType) -> Column:
    """A value as text, for columns that hold values of several types."""
    if kind == ValueType.INSTANT:
        return F.unix_micros(value).cast("string")
    return F.base64(value) if kind in (ValueType.BYTES, ValueType.BLOB) else value.cast("string")
