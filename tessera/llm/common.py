"""What the operators of this subpackage share: durable intermediate tables and Arrow text views."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting to delete a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most bytes of a batch that a Python worker gets.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Keys of texts are broadcast up to so many rows: the driver collects them and holds their hash table and its copies.
BROADCAST_ROWS = 1 << 16

_own_dir: list[str] = []

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return _own_dir[0]


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here delete their shuffle files, and send Python workers batches of few bytes."""
    ours = {CLEANUP: "true", BATCH: "8m"}
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches whose worker gives freed memory back at its end: workers live on through later stages."""

    def with_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return with_trim


def released() -> None:
    """Give freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage of df: write it as Parquet to the shared folder and read it again. Also its path, for removed()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):  # the table stands for the shuffles from here on
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of written() that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sought(keys: DataFrame, most: int | None = None) -> DataFrame:
    """Keys that rows of texts are joined with: broadcast if they are few. Others meet the texts in a shuffle, where each task
    hashes its keys, so that texts are not sorted."""
    return F.broadcast(keys) if keys.count() <= (BROADCAST_ROWS if most is None else most) else keys.hint("shuffle_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, so that no other column can clash with one it adds."""
    return docs.select(*(F.col(f"`{c}`").alias(k) for k, c in columns.items()))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two longs that name a row by id and text: rows that agree in both get equal results anyway."""
    return [F.xxhash64(id_col, text_col).alias("r1"), F.xxhash64(text_col, F.lit(7), id_col).alias("r2")]


def text_views(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `most` bytes of text (a row at least): rows, UTF-8 bytes, offsets. Null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).fill_null(b"")
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, made as far as they are asked for."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(self.n, b, np.uint64)))) for b in (self.base, self.inverse))
        return self.up, self.down


POWERS = Powers()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), signed(values))


def classes(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b longs): (node, comp), comp the least node that links reach.

    Each round points every node at the least label among its neighbours and then at that label's own label, so a chain of
    n nodes takes about log n rounds. Every round is written to the shared folder; only counts reach the driver.
    """
    spark = edges.sparkSession
    both, kept = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    paths = [kept]
    label, path = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), f"{name}-0")
    for k in range(1, 200):
        # a root (a label that others carry) takes over the least label that any node of its tree sees
        seen = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        tree = label.join(seen, "a").select("a", "l", F.least("l", "m").alias("m"))
        roots = tree.groupBy("l").agg(F.min("m").alias("m")).select(F.col("l").alias("k"), F.least("l", "m").alias("up"))
        hooked = tree.join(roots, tree["l"] == roots["k"]).select("a", F.col("l").alias("old"), F.least("m", "up").alias("l"))
        jump = hooked.select(F.col("a").alias("j"), F.col("l").alias("lj"))
        new, path_new = written(hooked.join(jump, hooked["l"] == jump["j"], "left").select("a", "old", F.coalesce(F.least("l", "lj"), "l").alias("l")), f"{name}-{k}")
        changed = new.where("old <> l").limit(1).count()
        removed(spark, path)
        label, path = new.select("a", "l"), path_new
        if not changed:
            break
    else:
        raise RuntimeError("the links' classes are not complete after 200 rounds")
    removed(spark, *paths)
    return label.select(F.col("a").alias("node"), F.col("l").alias("comp"))


def taught() -> Column:
    """True for the rows that a model may learn from: crc32 of doc_id as text modulo 3 is not 1. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def strata(df: DataFrame, by: str, each: int, seed: int = 11, most: int = 1000) -> DataFrame:
    """About `each` rows of each of the `most` most frequent values of `by`, chosen by a hash of doc_id: a stratum of fewer
    rows is kept whole."""
    counts = {r[0]: r[1] for r in df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(most).collect()}
    if not counts:
        return df.limit(0)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() if k is not None for x in (k, min(1.0, each / n)))), F.col(by))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(F.col(by).isin(list(counts)) & (u < share))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.p[k].dtype)
