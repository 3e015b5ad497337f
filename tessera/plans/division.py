"""Where repartitioning cuts: by counts of keys, or by row numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.stats import key_struct, key_tuple, looked_up
from tessera.sources.scratch import kept, scratch

SLICE = 1 << 20  # rows (by order key) that are numbered together
UNIT = 1 << 40  # sampling hashes are below it
#: Standard deviations between the share of rows that are surely sampled and the share that surely isn't.
SPREAD = 6


def sampled(df: DataFrame, pid: str, order: str, fraction: float, seed: int, step: int) -> DataFrame:
    """max(int(fraction * n), 1) rows of each partition of n rows, without replacement: those of the least seeded hashes of
    their order keys.

    Nearly all are told by the hash alone, where they are. Only rows whose hash is so near to the limit that chance decides
    are ranked, so a partition is never brought together in one task.
    """
    u = F.pmod(F.xxhash64(F.lit(seed) + F.col(pid) * step, order), F.lit(UNIT))
    df = df.withColumn("__u", u)
    wanted, spark = {}, df.sparkSession
    for p, n in df.groupBy(pid).count().collect():
        k = max(int(fraction * n), 1)
        slack = SPREAD * math.sqrt(k) + SPREAD**2
        wanted[p] = (k, int(UNIT * max(0.0, k - slack) / n), int(UNIT * min(1.0, (k + slack) / n)))
    if not wanted:
        return df.drop("__u")
    limits = looked_up(spark.createDataFrame([(p, *w) for p, w in wanted.items()], "__q int, __k long, __lo long, __hi long"), len(wanted))
    df = df.join(limits, F.col(pid) == F.col("__q")).where("__u < __hi")
    counts = {r[0]: (r["sure"], r["some"]) for r in df.groupBy(pid).agg(F.count_if(F.col("__u") < F.col("__lo")).alias("sure"), F.count("*").alias("some")).collect()}
    for p, (k, _, hi) in wanted.items():
        sure, some = counts.get(p, (0, 0))
        if sure > k or (some < k and hi < UNIT):
            raise RuntimeError("a sample's hashes are too uneven; take another seed")
    sure = df.where("__u < __lo")
    left = looked_up(spark.createDataFrame([(p, k - counts.get(p, (0, 0))[0]) for p, (k, *_) in wanted.items()], "__p int, __left long"), len(wanted))
    near = df.where("__u >= __lo").withColumn("__r", F.row_number().over(Window.partitionBy(pid).orderBy("__u", order)))
    near = near.join(left, F.col(pid) == F.col("__p")).where("__r <= __left")
    return sure.select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(near.select(*(F.col(f"`{c}`") for c in df.columns))).drop("__u", "__q", "__k", "__lo", "__hi")


def key_counts(df: DataFrame, pid: str, order: str, index_columns: tuple[str, ...], fraction: float, seed: int, step: int) -> DataFrame:
    """Rows for each key: of all rows or of a sample of each partition."""
    df = df.select(pid, order, *(F.col(f"`{c}`") for c in index_columns))
    if fraction < 1:
        df = sampled(df, pid, order, fraction, seed, step)
    return df.groupBy(*(F.col(f"`{c}`") for c in index_columns)).agg(F.count("*").alias("__c"))


def key_divisions(counts: DataFrame, index_columns: tuple[str, ...], rows: int) -> list[tuple[int, tuple, tuple]]:
    """(rows, first key, last key) of each part: a key's part is its inclusive running count // rows, so equal keys stay
    together and the key that reaches a multiple of `rows` opens the next part.

    The running count is taken in two steps, range by range of the keys, so that no task orders all keys; the driver gets a
    row for each range and each part.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in index_columns]
    with scratch(counts.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())) as ranged:
        before, total = {}, 0
        for p, c in sorted(map(tuple, ranged.groupBy("__p").agg(F.sum("__c")).collect())):
            before[p], total = total, total + c
        if not before:
            return []
        start = counts.sparkSession.createDataFrame(list(before.items()), "__p int, __b long")
        run = F.sum("__c").over(Window.partitionBy("__p").orderBy(*order)) + F.col("__b")
        key = key_struct(counts, index_columns)
        parts = ranged.join(looked_up(start, len(before)), "__p").withColumn("__part", F.floor(run / rows)).groupBy("__part")
        found = parts.agg(F.sum("__c").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    return [(r["n"], key_tuple(counts, index_columns, r["lo"]), key_tuple(counts, index_columns, r["hi"])) for r in sorted(found, key=lambda r: r["__part"])]


def row_divisions(sizes: list[int], rows: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Cuts (partition, offset) after every `rows` rows, and the sizes of the parts."""
    total, cuts, p, before = sum(sizes), [], 0, 0
    for at in range(rows, total, rows):
        while before + sizes[p] <= at:
            before, p = before + sizes[p], p + 1
        cuts.append((p, at - before))
    return cuts, [min(rows, total - at) for at in range(0, total, rows)]


def row_numbers(df: DataFrame, pid: str, order: str) -> DataFrame:
    """df with `__row`, the global row number by (pid, order). Slices of SLICE order keys are numbered on their own; the
    driver adds up a count for each. A slice that isn't as it was counted is an error: no row is lost in silence.

    The rows are written to the shared folder first: a sort draws its ranges anew in every job, and a join may deal its rows
    anew, so order keys made from tasks' numbers only hold within a job."""
    df = kept(df)
    head, last = F.slice(order, F.lit(1), F.size(order) - 1), F.element_at(order, -1)
    df = df.withColumns({"__h": head, "__s": F.floor(last / SLICE)})
    counts = sorted(map(tuple, df.groupBy(pid, "__h", "__s").agg(F.count("*").alias("c")).collect()))
    offsets, total = [], 0
    for *at, n in counts:
        offsets.append((*at, total, n))
        total += n
    start = df.sparkSession.createDataFrame(offsets, f"{pid} int, __h array<long>, __s long, __b long, __n long")
    w = Window.partitionBy(pid, "__h", "__s")
    df = df.join(looked_up(start, len(offsets)), [pid, "__h", "__s"], "left").withColumns({"__row": F.row_number().over(w.orderBy(order)) - 1 + F.col("__b"), "__m": F.count("*").over(w)})
    changed = F.raise_error(F.lit("the rows changed while they were numbered; write the dataset first")).cast("long")
    return df.withColumn("__row", F.when(F.col("__m").eqNullSafe(F.col("__n")), F.col("__row")).otherwise(changed)).drop("__h", "__s", "__b", "__n", "__m")
