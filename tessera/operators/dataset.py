"""Dataset: a lazy list of logical partitions over one Spark DataFrame, with a layout that the driver knows.

Two hidden columns travel along: the partition number and an order key within the partition. Partitions are logical; how Spark
splits the work is left to it. Every operator builds a plan; only those that say so run a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.functions.order import columns_geq, columns_gt, columns_leq, columns_lt, instant, lex_cmp, ordinal, sort_partitions
from tessera.plans.division import key_counts, key_divisions, row_divisions, row_numbers
from tessera.plans.layout import Layout
from tessera.plans.stats import partition_stats
from tessera.progress import Progress, workers
from tessera.sources.parquet import ORD, ORDER, PID, write_dataset

INCLUSIVE = {"none": (False, False), "lower": (True, False), "upper": (False, True), "both": (True, True)}
PRESERVES = ("none", "sizes", "bounds", "all")


def _names(columns) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


class Dataset:
    """Semantics of a list of DataFrames: len(ds), ds[i], iteration."""

    def __init__(self, df: DataFrame, layout: Layout):
        missing = [c for c in layout.index_columns if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        self._df, self._layout, self._spark = df, layout, df.sparkSession

    @property
    def _public(self) -> T.StructType:
        return T.StructType([f for f in self._df.schema if f.name not in (PID, ORD)])

    def _types(self, columns: Sequence[str]) -> list[T.DataType]:
        return [self._df.schema[c].dataType for c in columns]

    index_columns = property(lambda self: self._layout.index_columns, doc="Names of the index columns.")
    sizes = property(lambda self: self._layout.sizes, doc="Rows of each partition, or None.")
    lower_bounds = property(lambda self: self._layout.lower, doc="Least index tuple of each partition (or below it), or None.")
    upper_bounds = property(lambda self: self._layout.upper, doc="Largest index tuple of each partition (or above it), or None.")
    known_sizes = property(lambda self: self._layout.sizes is not None)
    known_bounds = property(lambda self: self._layout.known_bounds)
    known_schema = property(lambda self: True, doc="Spark analyses plans at once, so the schema is always known.")
    schema = property(lambda self: {f.name: f.dataType for f in self._public}, doc="Names and types of the columns.")

    def __len__(self) -> int:
        return self._layout.npartitions

    def __getitem__(self, i: int) -> DataFrame:
        if not isinstance(i, int):
            raise TypeError("partitions are picked by a number")
        if not -len(self) <= i < len(self):
            raise IndexError("partition number out of range")
        return self._df.where(F.col(PID) == i % len(self)).drop(PID, ORD)

    def __iter__(self) -> Iterator[DataFrame]:
        return (self[i] for i in range(len(self)))

    def to_dataframe(self, partition_column: str | None = None) -> DataFrame:
        """All rows, lazily and in no order; with the partition numbers under a name of choice."""
        df = self._df.drop(ORD)
        return df.withColumnRenamed(PID, partition_column) if partition_column else df.drop(PID)

    def collect(self, parallel=False, progress=False) -> pa.Table:
        """All rows on the driver, in order of partitions and rows (runs a job)."""
        workers(parallel)
        with Progress(self._spark, progress):
            return self._df.orderBy(PID, ORD).drop(PID, ORD).toArrow()

    def is_disjoint(self) -> bool:
        """Whether the partitions' index ranges don't overlap. StatsUnknownError without bounds."""
        return self._layout.disjoint()

    def assert_disjoint(self) -> "Dataset":
        if not self.is_disjoint():
            raise AssertionError("the index ranges of some partitions overlap")
        return self

    def rename(self, mapping: dict[str, str]) -> "Dataset":
        """Rename columns, index columns too; statistics stay."""
        unknown = [c for c in mapping if c not in self.schema]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        _check_hidden(mapping.values())
        lay = self._layout
        return Dataset(self._df.withColumnsRenamed(mapping), Layout(len(self), tuple(mapping.get(c, c) for c in lay.index_columns), lay.sizes, lay.lower, lay.upper))

    def slice(self, lb=None, ub=None, inclusive: str = "lower") -> "Dataset":
        """Rows with lb <= index < ub (which ends count: `inclusive`), by the order with nulls first. Bounds may be shorter than
        the index: they are compared with as many columns. Partitions that can't hold such rows go."""
        if inclusive not in INCLUSIVE:
            raise ValueError(f"inclusive must be one of {', '.join(INCLUSIVE)}")
        bound = lambda b: None if b is None else tuple(b) if isinstance(b, (tuple, list)) else (b,)
        kinds = self._types(self.index_columns)
        lb, ub = (b if b is None or len(b) > len(kinds) else tuple(map(instant, b, kinds)) for b in (bound(lb), bound(ub)))
        if any(b is not None and len(b) > len(self.index_columns) for b in (lb, ub)):
            raise ValueError("a bound has more values than there are index columns")
        low, up = INCLUSIVE[inclusive]
        layout, keep = self._layout.sliced(lb, ub, low, up)
        df = _picked(self._df, keep, len(self))
        if lb is not None:
            c = self.index_columns[: len(lb)]
            df = df.where((columns_geq if low else columns_gt)(c, lb, self._types(c)))
        if ub is not None:
            c = self.index_columns[: len(ub)]
            df = df.where((columns_leq if up else columns_lt)(c, ub, self._types(c)))
        return Dataset(df, layout)

    def reindex(self, index_columns=None, collect_stats: bool = True, parallel=False, progress=False) -> "Dataset":
        """Set the index columns and find sizes and bounds. Runs no job where they are known or the new index is a prefix of
        the old one; else one aggregate, after which partitions without rows are gone."""
        workers(parallel)
        index = self.index_columns if index_columns is None else _names(index_columns)
        lay = self._layout
        if index == lay.index_columns and lay.known_bounds and (lay.sizes is not None or not collect_stats):
            return self
        if lay.known_bounds and index == lay.index_columns[: len(index)] and (lay.sizes is not None or not collect_stats):
            return Dataset(self._df, lay.truncated(len(index)))
        if not collect_stats:
            return Dataset(self._df, lay.without_bounds(index))
        Dataset(self._df, lay.without_bounds(index))  # checks the names
        with Progress(self._spark, progress):
            stats = partition_stats(self._df, PID, index)
        return Dataset(_picked(self._df, [s[0] for s in stats], len(self)), Layout(len(stats), index, *(tuple(s[k] for s in stats) for k in (1, 2, 3))))

    def collate(self, rows_per_partition: int) -> "Dataset":
        """Merge neighbouring partitions, in order of bounds, until each has the wanted rows; none is split."""
        batches = self._layout.batches(rows_per_partition)
        order = [p for b in batches for p in b]
        place = {p: (k, i) for k, b in enumerate(batches) for i, p in enumerate(b)}
        rank = _mapped({p: i for i, p in enumerate(order)})
        df = self._df.withColumns({ORD: _before(rank), PID: _mapped({p: k for p, (k, _) in place.items()})}) if batches else self._df
        return Dataset(df, self._layout.merged(batches))

    def map(self, func: Callable, extra_args: Sequence[Sequence] | None = None, shared_args: Sequence = (), index_columns=None, schema=None, preserves: str = "none", rowwise: bool = True) -> "Dataset":
        """Apply a function. `rowwise`: func(df, *shared_args), or func(df, *extra, *shared_args) where each partition's own
        arguments come as Columns, on the DataFrame of all partitions, with Spark's functions. Otherwise
        func(table, *extra_args[i], *shared_args) from and to an Arrow table, partition by partition.

        `preserves` says what the function leaves alone: none, sizes, bounds or all; it is trusted. `schema` casts the result.
        """
        if preserves not in PRESERVES:
            raise ValueError(f"preserves must be one of {', '.join(PRESERVES)}")
        index = self.index_columns if index_columns is None else _names(index_columns)
        lay = self._layout
        if preserves in ("bounds", "all") and index != lay.index_columns:
            raise ValueError("bounds can't be preserved while the index columns change")
        if extra_args is not None and len(extra_args) != len(self):
            raise ValueError("extra_args must have an entry for each partition")
        kind = None if schema is None else schema if isinstance(schema, T.StructType) else T.StructType([T.StructField(k, v) for k, v in schema.items()])
        df = self._row_map(func, extra_args, shared_args) if rowwise else self._table_map(func, extra_args, shared_args, kind)
        if kind is not None:
            df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind), PID, ORD)
        keep = preserves in ("bounds", "all") and lay.known_bounds
        return Dataset(df, Layout(len(self), index, lay.sizes if preserves in ("sizes", "all") else None, lay.lower if keep else None, lay.upper if keep else None))

    def _row_map(self, func, extra_args, shared_args) -> DataFrame:
        extra = []
        if extra_args and len(extra_args[0]):
            extra = [_mapped({p: a[k] for p, a in enumerate(extra_args)}) for k in range(len(extra_args[0]))]
        out = func(self._df, *extra, *shared_args)
        if not {PID, ORD} <= set(out.columns):
            raise ValueError("a row-wise function must keep the rows' hidden columns: use withColumn, where or select('*', ...), or rowwise=False")
        return out.select(*(c for c in out.columns if c not in (PID, ORD)), PID, ORD)

    def _table_map(self, func, extra_args, shared_args, kind: T.StructType | None) -> DataFrame:
        args = lambda p: (*(extra_args[p] if extra_args is not None else ()), *shared_args)
        blank = to_arrow_schema(self._public).empty_table()
        if kind is None:
            kind = from_arrow_schema(func(blank, *args(0)).schema, prefer_timestamp_ntz=True) if len(self) else self._public
        _check_hidden(kind.names)
        out = T.StructType([*kind.fields, T.StructField(PID, T.IntegerType()), T.StructField(ORD, ORDER)])
        arrow = to_arrow_schema(kind)

        def run(table: pa.Table) -> pa.Table:
            p = table.column(PID)[0].as_py()
            return _hidden(func(table.take(_sorted(table.column(ORD))).drop_columns([PID, ORD]), *args(p)).select(arrow.names).cast(arrow), p)

        df = self._df.groupBy(PID).applyInArrow(run, out)
        empty = [p for p, n in enumerate(self.sizes or ()) if not n]  # a group without rows is never called by Spark
        rows = [(func(blank, *args(p)), p) for p in empty]
        rows = [(t.select(arrow.names).cast(arrow), p) for t, p in rows if len(t)]
        for t, p in rows:
            df = df.unionByName(self._spark.createDataFrame(_hidden(t, p)))
        return df

    def join(self, other: "Dataset", how: str = "inner") -> "Dataset":
        """Equi-join on all index columns: inner, left or full. Null keys match nothing. inner and left keep the left columns and
        the right ones that aren't keys; full has the right keys too, as <key>_right. Partitions are the ranges between the
        distinct lower bounds of both sides. Spark picks the physical join; sides aren't broadcast by us."""
        if not isinstance(other, Dataset):
            raise ValueError("other must be a Dataset")
        if how not in ("inner", "left", "full"):
            raise ValueError("how must be inner, left or full")
        if not (self.known_bounds and other.known_bounds):
            raise ValueError("Bounds must be known; use reindex first.")
        index = self.index_columns
        if index != other.index_columns or not index:
            raise ValueError("both sides need the same index columns, one at least")
        rest = [c for c in other.schema if c not in index]
        right_keys = {c: f"{c}_right" for c in index}
        clash = (set(rest) & set(self.schema)) | (set(right_keys.values()) & {*self.schema, *rest} if how == "full" else set())
        if clash:
            raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
        both = [*self._layout.lower, *other._layout.lower]
        divisions = [both[i] for i in sort_partitions(both, both)]
        divisions = [d for k, d in enumerate(divisions) if not k or lex_cmp(d, divisions[k - 1])]
        left = self._df.drop(PID, ORD).withColumn("__l", F.lit(True))
        right = other._df.drop(PID, ORD).withColumnsRenamed({c: f"__r_{k}" for k, c in enumerate(index)})
        on = reduce(lambda a, b: a & b, (left[c] == right[f"__r_{k}"] for k, c in enumerate(index)))
        df = left.join(right, on, how)
        key = [F.when(F.col("__l"), F.col(f"`{c}`")).otherwise(F.col(f"__r_{k}")) for k, c in enumerate(index)]
        pid = ordinal(key, divisions, self._types(index))
        shown = [F.col(f"`{c}`") for c in [*self.schema, *rest]]
        if how == "full":
            shown += [F.col(f"__r_{k}").alias(right_keys[c]) for k, c in enumerate(index)]
        return Dataset(df.select(*shown, pid.alias(PID), F.array(F.monotonically_increasing_id()).alias(ORD)), Layout(len(divisions) + 1, index))

    def repartition(self, rows_per_partition: int, index_columns=None, sample_fraction: float = 1.0, parallel=False, progress=False, base_seed: int = 10, seed_increment: int = 10) -> "Dataset":
        """Rebalance (runs a job). With an index: ranges of keys of about rows_per_partition rows, equal keys together, from
        the counts of all keys or of those of a sample; sizes and bounds are known where all rows were counted. Without: exact
        chunks of rows in their order."""
        workers(parallel)
        if rows_per_partition < 1:
            raise ValueError("rows_per_partition must be positive")
        index = self.index_columns if index_columns is None else _names(index_columns)
        if not len(self):
            return self
        if not index:
            ds = self if self.known_sizes else self.reindex(progress=progress)
            _, sizes = row_divisions(list(ds.sizes), rows_per_partition)
            if not sizes:
                return Dataset(ds._df, Layout(0, (), ()))
            with Progress(self._spark, progress):
                df = row_numbers(ds._df, PID, ORD)
            df = df.withColumns({ORD: F.array("__row"), PID: F.floor(F.col("__row") / rows_per_partition).cast("int")})
            return Dataset(df.select(*(F.col(f"`{c}`") for c in ds.schema), PID, ORD), Layout(len(sizes), (), tuple(sizes)))
        Dataset(self._df, Layout(len(self), index, None, None, None))  # checks the names
        fraction = min(1.0, sample_fraction)
        with Progress(self._spark, progress):
            counts = key_counts(self._df, PID, ORD, index, fraction, base_seed, seed_increment)
            parts = key_divisions(counts, index, max(1, int(fraction * rows_per_partition)))
        if not parts:
            return Dataset(self._df, Layout(0, index, (), (), ()))
        key = [F.col(f"`{c}`") for c in index]
        pid = ordinal(key, [p[1] for p in parts[1:]], self._types(index))
        df = self._df.withColumns({ORD: _before(F.col(PID)), PID: pid})
        exact = fraction >= 1
        return Dataset(df, Layout(len(parts), index, *((tuple(p[k] for p in parts) for k in range(3)) if exact else (None, None, None))))

    def write_parquet(self, path: str, append: bool = False, parallel=False, progress=False) -> "Dataset | None":
        """Write a folder for each partition that has rows, and a manifest. Returns the dataset there, or None when appending.
        Only whole results take a path's place, so a dataset may be written over its own source."""
        workers(parallel)
        with Progress(self._spark, progress):
            return write_dataset(self, path, append)


def _check_hidden(names) -> None:
    if taken := {PID, ORD} & set(names):
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")


def _mapped(values: dict[int, Any]) -> Column:
    """What each partition number stands for: looked up by place; numbers without a value give null."""
    return F.get(F.array(*(F.lit(values.get(p)) for p in range(max(values, default=-1) + 1))), F.col(PID))


def _before(first: Column) -> Column:
    """The order key behind another one that counts first."""
    return F.concat(F.array(first.cast("long")), F.col(ORD))


def _sorted(order: pa.ChunkedArray) -> pa.Array:
    """The places of order keys in their order; a shorter key comes before those that it begins."""
    keys = order.combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    size, flat = np.asarray(keys.value_lengths()), np.asarray(keys.flatten())
    grid = np.full((len(size), max(size, default=0)), np.iinfo(np.int64).min)
    grid[np.arange(grid.shape[1]) < size[:, None]] = flat
    return pa.array(np.lexsort(grid.T[::-1]))


def _hidden(table: pa.Table, pid: int) -> pa.Table:
    """A partition's table with its hidden columns."""
    n = len(table)
    keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.arange(n), pa.int64()))
    return table.append_column(PID, pa.array(np.full(n, pid), pa.int32())).append_column(ORD, keys)


def _picked(df: DataFrame, keep: list[int], n: int) -> DataFrame:
    """The partitions of `keep`, numbered anew in that order. The filter on the old numbers prunes folders and files."""
    if keep == list(range(n)):
        return df
    if not keep:
        return df.where(F.lit(False))
    df = df.where(F.col(PID).isin(keep))
    return df.withColumn(PID, _mapped({p: i for i, p in enumerate(keep)}))


def from_dataframe(data, index_columns=(), partition_ids=None, npartitions: int | None = None, spark: SparkSession | None = None, order_by=None) -> Dataset:
    """A dataset of one partition from a Spark or pandas DataFrame or an Arrow table, with its statistics (runs a job).

    Rows keep the order that Spark reads them in, or that of the columns `order_by` (nulls first), by which they are sorted
    in ranges, so that no task holds them all. `partition_ids`, a Column of ints from 0, deals the rows to `npartitions` partitions instead; statistics then come with
    reindex(). No rows and an index: no partitions.
    """
    if not isinstance(data, DataFrame):
        data = (spark or SparkSession.getActiveSession()).createDataFrame(data)
    _check_hidden(data.columns)
    index = _names(index_columns)
    if order_by is not None:
        data = data.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in _names(order_by)))
    df = data.withColumns({PID: (F.lit(0) if partition_ids is None else partition_ids).cast("int"), ORD: F.array(F.monotonically_increasing_id())})
    if partition_ids is not None:
        if npartitions is None:
            npartitions = (df.agg(F.max(PID)).first()[0] or 0) + 1
        return Dataset(df, Layout(npartitions, index))
    Dataset(df, Layout(1, index))
    stats = partition_stats(df, PID, index)
    if not stats:
        return Dataset(df, Layout(0, index, (), (), ()) if index else Layout(1, (), (0,)))
    return Dataset(df, Layout(1, index, *((s,) for s in stats[0][1:])))


def concat(datasets, spark: SparkSession | None = None) -> Dataset:
    """The partitions of all datasets, one after the other. They need equal index columns and schemas; datasets without
    partitions are passed over."""
    try:
        datasets = list(datasets)
    except TypeError as e:
        raise ValueError("concat needs datasets") from e
    if not all(isinstance(d, Dataset) for d in datasets):
        raise ValueError("concat needs datasets")
    full = [d for d in datasets if len(d)]
    if not full:
        if datasets:
            return datasets[0]
        hidden = T.StructType([T.StructField(PID, T.IntegerType()), T.StructField(ORD, ORDER)])
        return Dataset((spark or SparkSession.getActiveSession()).createDataFrame([], hidden), Layout(0, (), ()))
    first = full[0]
    if any(d.index_columns != first.index_columns for d in full):
        raise ValueError("the index columns differ")
    if any([(f.name, f.dataType) for f in d._public] != [(f.name, f.dataType) for f in first._public] for d in full):
        raise ValueError("the schemas differ")
    parts, offset = [], 0
    for d in full:
        parts.append(d._df.select(*(F.col(f"`{c}`") for c in d.schema), (F.col(PID) + offset).cast("int").alias(PID), ORD))
        offset += len(d)
    known = all(d.known_sizes for d in full)
    bounds = all(d.known_bounds for d in full)
    flat = lambda f: tuple(x for d in full for x in f(d))
    layout = Layout(offset, first.index_columns, flat(lambda d: d.sizes) if known else None, flat(lambda d: d.lower_bounds) if bounds else None, flat(lambda d: d.upper_bounds) if bounds else None)
    return Dataset(reduce(DataFrame.unionByName, parts), layout)


__all__ = ["Dataset", "concat", "from_dataframe"]
