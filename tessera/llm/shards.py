"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, removed, written


def differencing(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions (rows of k sums) until one is left: for each row, the shard that each of its k sums joins.

    The two rows of the largest spread (largest minus least sum) are combined again and again, one ascending and the other
    descending, so that large sums meet small ones. Sums are kept less their row's least, which no spread depends on.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    order = np.empty((2 * n - 1, k), np.int32)  # of each node: the slot of the combined node that each of its own slots is in
    left, right = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1)
    base = parts.min(axis=1, keepdims=True)
    sums = {i: row for i, row in enumerate(parts - base)}
    heap = [(-int(row.max()), i) for i, row in sums.items()]
    heapq.heapify(heap)
    slots = np.arange(k, dtype=np.int32)
    for node in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        up, down = np.argsort(x, kind="stable"), np.argsort(-y, kind="stable")
        s = x[up] + y[down]
        order[a, up], order[b, down] = slots, slots
        left[node], right[node] = a, b
        s -= s.min()
        sums[node] = s
        heapq.heappush(heap, (-int(s.max()), node))
    order[2 * n - 2] = slots
    for node in range(2 * n - 2, n - 1, -1):
        for child in (left[node], right[node]):
            order[child] = order[node][order[child]]
    return order[:n].astype(np.int64)


def local_partition(shards: int):
    """One bucket of groups: each group's part of the bucket, and how many rows of the part stand before it."""

    def run(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "gid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rows = np.zeros((len(groups), shards), np.int64)
        rows[:, 0] = groups["bytes"]
        part = differencing(rows)[:, 0]
        before = groups["n"].groupby(part).cumsum() - groups["n"]
        return pd.DataFrame({"gid": groups["gid"], "bucket": key[0], "part": part.astype(np.int32), "before": before, "n": groups["n"], "bytes": groups["bytes"]})

    return run


def combined(shards: int):
    """Buckets that are differenced together: the part of the whole that each bucket's parts join, and how many rows of it
    stand before them."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(parts["bucket"])
        table = np.zeros((len(names), shards, 2), np.int64)
        at = np.searchsorted(names, parts["bucket"])
        table[at, parts["part"]] = parts[["bytes", "n"]]
        place = differencing(table[:, :, 0])
        filled, start = np.zeros(shards, np.int64), np.zeros((len(names), shards), np.int64)
        for b in range(len(names)):
            start[b] = filled[place[b]]
            filled[place[b]] += table[b, :, 1]
        every = {"bucket": np.repeat(names, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(names))}
        return pd.DataFrame(every | {"upper": key[0], "upper_part": place.ravel().astype(np.int32), "start": start.ravel(), "n": table[:, :, 1].ravel(), "bytes": table[:, :, 0].ravel()})

    return run


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", *, bucket_groups: int = 20_000, together: int = 1024, slice_rows: int = 2000, broadcast_rows: int = 1 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): all rows in `shards` shards of nearly equal bytes.

    Groups of equal texts are indivisible. Groups go to buckets of about `bucket_groups` by hash; each bucket is differenced
    on its own. Up to `together` buckets' parts are differenced in turn in one task, and what they become is again, level by
    level, until one bucket is left, whose parts are the shards. Slots count rows from 0 in each shard without gaps: part by
    part, group by group, and in a group by slices of about `slice_rows` rows, so that no task numbers a hot group.

    Null text: size 8, crc32 0, one group of its own kind (with the empty texts, which are equal to it in bytes). Null ids and
    repeated rows each get their slot. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("gid"))
    rows, p_rows = written(rows, "shards-rows")
    groups, p_groups = written(rows.groupBy("gid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shards-groups")
    buckets = max(1, -(-groups.count() // bucket_groups))
    parts = groups.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)).cast("int"))
    parts, p_parts = written(parts.groupBy("bucket").applyInPandas(local_partition(shards), "gid binary, bucket int, part int, before long, n long, bytes long"), "shards-parts")
    paths = [p_rows, p_groups, p_parts]
    homes = parts.select("gid", "n", "bucket", "part", F.col("before").alias("first"))
    level = parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    while True:  # at least once, so that the last level's parts are the shards
        upper = max(1, -(-buckets // together))
        level = level.withColumn("upper", F.pmod("bucket", F.lit(upper)).cast("int"))
        level, path = written(level.groupBy("upper").applyInPandas(combined(shards), "bucket int, part int, upper int, upper_part int, start long, n long, bytes long"), "shards-level")
        paths.append(path)
        up = level.select("bucket", "part", "upper", "upper_part", "start")
        homes = homes.join(F.broadcast(up) if buckets * shards <= broadcast_rows else up, ["bucket", "part"])
        homes = homes.select("gid", "n", F.col("upper").alias("bucket"), F.col("upper_part").alias("part"), (F.col("first") + F.col("start")).alias("first"))
        if upper == 1:
            break
        level, buckets = level.groupBy(F.col("upper").alias("bucket"), F.col("upper_part").alias("part")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), upper
    homes = homes.select("gid", F.col("part").alias("shard"), "first", F.ceil(F.col("n") / slice_rows).alias("cuts"))
    # written rows keep their numbers, so ids that are null or repeated are cut up too
    rows = rows.withColumn("i", F.monotonically_increasing_id())
    placed, path = written(rows.join(homes, "gid").withColumn("cut", F.pmod(F.xxhash64("i"), F.col("cuts"))), "shards-placed")
    paths.append(path)
    counts = placed.where("cuts > 1").groupBy("gid", "cut").agg(F.count("*").alias("c"))
    before = counts.select("gid", "cut", F.expr("sum(c) over (partition by gid order by cut) - c").alias("skip"))
    placed = placed.join(before, ["gid", "cut"], "left").withColumn("slot", F.expr("first + coalesce(skip, 0) + row_number() over (partition by gid, cut order by doc_id, i) - 1"))
    out = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out, _ = written(out, "shards-out")
    removed(spark, *paths)
    return out
