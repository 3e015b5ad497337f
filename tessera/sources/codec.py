"""Bounds in the manifest: plain JSON values, read by the types of the schema that the manifest holds beside them.

Instants, date-times, times of day and intervals are microseconds; dates and decimals are text, bytes are hexadecimal, and floats
that JSON lacks are named.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

from pyspark.sql import types as T

from tessera.errors import DecodingError
from tessera.functions.order import EPOCH, MICRO, instant

LOCAL = EPOCH.replace(tzinfo=None)


def encode(value, kind: T.DataType):
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dt.datetime):
        return (instant(value, kind) - EPOCH if isinstance(kind, T.TimestampType) else value - LOCAL) // MICRO
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dt.time):
        return (dt.datetime.combine(LOCAL, value) - LOCAL) // MICRO
    if isinstance(value, dt.timedelta):
        return value // MICRO
    raise TypeError(f"a bound of type {type(value).__name__} can't be kept")


def decode(x, kind: T.DataType):
    if x is None:
        return None
    try:
        if isinstance(kind, T.TimestampType):
            return EPOCH + x * MICRO
        if isinstance(kind, T.TimestampNTZType):
            return LOCAL + x * MICRO
        if isinstance(kind, T.DayTimeIntervalType):
            return x * MICRO
        if kind.typeName().startswith("time("):
            return (LOCAL + x * MICRO).time()
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(x)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(x)
        if isinstance(kind, T.BinaryType):
            return bytes.fromhex(x)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(x)
        if isinstance(kind, T.StringType) != isinstance(x, str):
            raise ValueError(f"{x!r} is not of type {kind.simpleString()}")
        return x
    except (TypeError, ValueError, decimal.InvalidOperation) as e:
        raise DecodingError(f"{x!r} is no bound of type {kind.simpleString()}") from e


def encode_all(bounds, kinds) -> list[list] | None:
    """Tuples of bounds, a value for each type; None where bounds aren't known."""
    return None if bounds is None else [[encode(v, k) for v, k in zip(b, kinds)] for b in bounds]


def decode_all(bounds, kinds) -> tuple[tuple, ...] | None:
    return None if bounds is None else tuple(tuple(decode(v, k) for v, k in zip(b, kinds)) for b in bounds)
