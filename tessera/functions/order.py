"""One order for everything: lexicographic, ascending, nulls first, NaN last; on the driver and as Spark predicates.

Spark compares structs in this order. Such comparisons don't reach the Parquet scan, so each predicate is the struct comparison
joined with an expanded form that it implies and that does.

Values of `timestamp` columns are instants: on the driver they are date-times in UTC, in plans microseconds since 1970, so that
neither the session's time zone nor Python's shifts them. A date-time without a zone is taken in Python's own, as Spark does.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
MICRO = dt.timedelta(microseconds=1)


def rank(value) -> tuple:
    """A key by which Python's own order of tuples is this order."""
    if value is None:
        return (0,)
    return (2,) if value != value else (1, value)


def lex_key(values: Sequence) -> tuple:
    return tuple(map(rank, values))


def _sign(a: tuple, b: tuple) -> int:
    return int(a > b) - int(a < b)


def nullable_cmp(a, b) -> int:
    return _sign(rank(a), rank(b))


def lex_cmp(a: Sequence, b: Sequence) -> int:
    if len(a) != len(b):
        raise ValueError(f"tuples of {len(a)} and {len(b)} values have no order")
    return _sign(lex_key(a), lex_key(b))


def sort_partitions(lower: Sequence[tuple], upper: Sequence[tuple]) -> list[int]:
    """Partition numbers by lower bound, then upper bound."""
    keys = {i: (lex_key(lo), lex_key(up)) for i, (lo, up) in enumerate(zip(lower, upper))}
    return sorted(keys, key=keys.get)


def instant(value, kind: T.DataType):
    """A value as this library keeps it: of `timestamp` columns a date-time in UTC, of all others itself."""
    return value.astimezone(dt.timezone.utc) if isinstance(kind, T.TimestampType) and isinstance(value, dt.datetime) else value


def carried(column: Column, kind: T.DataType) -> Column:
    """A column in the form in which its values travel to the driver; see received()."""
    return F.unix_micros(column) if isinstance(kind, T.TimestampType) else column


def received(value, kind: T.DataType):
    if isinstance(value, bytearray):
        return bytes(value)
    return EPOCH + value * MICRO if isinstance(kind, T.TimestampType) and value is not None else value


def literal(value, kind: T.DataType | None = None) -> Column:
    """A literal of the given type; date-times without an instant go by their text, which no session time zone shifts."""
    if isinstance(value, dt.datetime):
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit((instant(value, kind) - EPOCH) // MICRO))
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast(kind or T.TimestampNTZType())
    out = F.lit(bytes(value) if isinstance(value, bytearray) else value)
    return out.cast(kind) if kind is not None else out


def _struct(columns: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns)))


class Cell:
    """One column against one value of a bound. Parquet's statistics leave NaN out, so where a NaN may count, the comparison
    asks for it in a way that the scan doesn't take over."""

    def __init__(self, column: Column, value, kind: T.DataType | None):
        self.x, self.value, self.lit = column, value, literal(value, kind)
        self.nan = value is not None and value != value
        self.floats = isinstance(value, float) if kind is None else isinstance(kind, (T.FloatType, T.DoubleType))

    def below(self) -> Column:
        if self.value is None:
            return F.lit(False)
        return self.x.isNull() | (~F.isnan(self.x) if self.nan else self.x < self.lit)

    def above(self) -> Column:
        if self.value is None:
            return self.x.isNotNull()
        if self.nan:
            return F.lit(False)
        return F.isnan(self.x) | (self.x > self.lit) if self.floats else self.x > self.lit

    def equal(self) -> Column:
        if self.value is None:
            return self.x.isNull()
        return F.isnan(self.x) if self.nan else self.x == self.lit


def _predicate(columns: Sequence[str], bound: Sequence, types: Sequence[T.DataType] | None, side: str, inclusive: bool) -> Column:
    if len(columns) != len(bound):
        raise ValueError("a bound needs a value for each column")
    if not columns:
        return F.lit(inclusive)
    cells = [Cell(F.col(f"`{c}`"), v, types[k] if types else None) for k, (c, v) in enumerate(zip(columns, bound))]
    left, right = _struct([c.x for c in cells]), _struct([c.lit for c in cells])
    exact = {("below", True): left <= right, ("below", False): left < right, ("above", True): left >= right, ("above", False): left > right}[side, inclusive]
    expanded = F.lit(False)
    for k in reversed(range(len(cells))):  # strict here, or equal here and the rest as it is
        rest = cells[k].equal() & expanded if k < len(cells) - 1 else cells[k].equal() if inclusive else None
        strict = getattr(cells[k], side)()
        expanded = strict if rest is None else strict | rest
    return expanded & exact


def columns_lt(columns, bound, types=None) -> Column:
    return _predicate(columns, bound, types, "below", False)


def columns_leq(columns, bound, types=None) -> Column:
    return _predicate(columns, bound, types, "below", True)


def columns_gt(columns, bound, types=None) -> Column:
    return _predicate(columns, bound, types, "above", False)


def columns_geq(columns, bound, types=None) -> Column:
    return _predicate(columns, bound, types, "above", True)


def ordinal(key: Sequence[Column], divisions: Sequence[tuple], types: Sequence[T.DataType]) -> Column:
    """How many of the sorted divisions are at most the key: a balanced tree of comparisons, of logarithmic depth."""
    left = _struct(key)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(left < _struct([literal(v, t) for v, t in zip(divisions[mid], types)]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(divisions)).cast("int")


__all__ = ["columns_geq", "columns_gt", "columns_leq", "columns_lt", "lex_cmp", "lex_key", "nullable_cmp", "sort_partitions"]
