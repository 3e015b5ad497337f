"""The layout of a dataset: logical partitions, index columns, row counts and lexicographic bounds. Driver-side, immutable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from tessera.errors import StatsUnknownError
from tessera.functions.order import lex_cmp, lex_key, sort_partitions


@dataclass(frozen=True)
class Layout:
    npartitions: int
    index_columns: tuple[str, ...] = ()
    sizes: tuple[int, ...] | None = None
    lower: tuple[tuple, ...] | None = None
    upper: tuple[tuple, ...] | None = None

    def __post_init__(self):
        if self.npartitions < 0:
            raise ValueError("the number of partitions can't be negative")
        if not self.index_columns:
            for name in ("lower", "upper"):
                object.__setattr__(self, name, ((),) * self.npartitions)
        if self.sizes is not None and len(self.sizes) != self.npartitions:
            raise ValueError("sizes must have an entry for each partition")
        if (self.lower is None) != (self.upper is None):
            raise ValueError("both bounds or none must be known")
        for bounds in (self.lower, self.upper):
            if bounds is not None and (len(bounds) != self.npartitions or any(len(b) != len(self.index_columns) for b in bounds)):
                raise ValueError("bounds must have a tuple for each partition, with a value for each index column")

    @property
    def known_bounds(self) -> bool:
        return self.lower is not None

    def without_bounds(self, index_columns: tuple[str, ...] | None = None) -> "Layout":
        return replace(self, index_columns=self.index_columns if index_columns is None else index_columns, lower=None, upper=None)

    def truncated(self, n: int) -> "Layout":
        """The layout for the first n index columns: bounds are cut, nothing is read."""
        return replace(self, index_columns=self.index_columns[:n], lower=tuple(b[:n] for b in self.lower), upper=tuple(b[:n] for b in self.upper))

    def pick(self, pids: Sequence[int]) -> "Layout":
        take = lambda x: None if x is None else tuple(x[p] for p in pids)
        return Layout(len(pids), self.index_columns, take(self.sizes), take(self.lower), take(self.upper))

    def disjoint(self) -> bool:
        if self.npartitions <= 1 or not self.index_columns:
            return True
        if not self.known_bounds:
            raise StatsUnknownError("Bounds must be known to check disjointness; use reindex first.")
        order = sort_partitions(self.lower, self.upper)
        return all(lex_cmp(self.upper[a], self.lower[b]) < 0 for a, b in zip(order, order[1:]))

    def batches(self, rows: int) -> list[list[int]]:
        """Partitions in order of bounds, merged until a batch has the wanted rows; none is split."""
        if self.sizes is None or not self.known_bounds:
            raise ValueError("Sizes and bounds must be known; use reindex first.")
        out, held, n = [], [], 0
        for p in sort_partitions(self.lower, self.upper):
            held.append(p)
            n += self.sizes[p]
            if n >= rows:
                out.append(held)
                held, n = [], 0
        return [*out, held] if held else out

    def merged(self, batches: Sequence[Sequence[int]]) -> "Layout":
        return Layout(
            len(batches),
            self.index_columns,
            tuple(sum(self.sizes[p] for p in b) for b in batches),
            tuple(min((self.lower[p] for p in b), key=lex_key) for b in batches),
            tuple(max((self.upper[p] for p in b), key=lex_key) for b in batches),
        )

    def sliced(self, lb: tuple | None, ub: tuple | None, lower_in: bool, upper_in: bool) -> tuple["Layout", list[int]]:
        """The layout of the rows between the bounds, and the partitions that can hold some."""
        if not self.known_bounds:
            raise ValueError("Bounds must be known; use reindex first.")
        cut = lambda b, ref: b[: len(ref)]
        above = lambda b: lb is None or lex_cmp(lb, cut(b, lb)) < lower_in  # noqa: E731  lb < b, or lb <= b
        below = lambda b: ub is None or lex_cmp(cut(b, ub), ub) < upper_in
        keep = [p for p in range(self.npartitions) if above(self.upper[p]) and below(self.lower[p])]
        got = self.pick(keep)
        whole = all(above(b) for b in got.lower) and all(below(b) for b in got.upper)
        n = len(self.index_columns)
        low, up = list(got.lower), list(got.upper)
        if lb is not None:  # nulls come first, so a short bound filled up with them is a lower bound
            fill = lb + (None,) * (n - len(lb))
            low = [max(b, fill, key=lex_key) for b in low]
        if ub is not None and len(ub) == n:  # only a full bound limits what the last columns hold
            up = [min(b, ub, key=lex_key) for b in up]
        return Layout(len(keep), self.index_columns, got.sizes if whole else None, tuple(low), tuple(up)), keep
