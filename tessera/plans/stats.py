"""Row counts and bounds of all partitions in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions.order import carried, received


#: Look-up tables of the driver's are broadcast up to so many rows; beyond that Spark joins them by a shuffle.
BROADCAST_ROWS = 1 << 20


def looked_up(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def key_struct(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The index columns as one struct, in the form in which they travel to the driver."""
    return F.struct(*(carried(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"c{k}") for k, c in enumerate(columns)))


def key_tuple(df: DataFrame, columns: tuple[str, ...], row: Row) -> tuple:
    return tuple(received(v, df.schema[c].dataType) for c, v in zip(columns, row))


def partition_stats(df: DataFrame, pid: str, index_columns: tuple[str, ...]) -> list[tuple[int, int, tuple, tuple]]:
    """(pid, rows, lower bound, upper bound) of each partition that has rows, in order; a row for each reaches the driver."""
    bounds = [f(key_struct(df, index_columns)) for f in (F.min, F.max)] if index_columns else []
    rows = df.groupBy(pid).agg(F.count("*"), *bounds).collect()
    return sorted(((r[0], r[1], *((key_tuple(df, index_columns, r[k]) for k in (2, 3)) if index_columns else ((), ()))) for r in rows), key=lambda x: x[0])
