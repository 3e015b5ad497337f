"""A query for every operator, over whole tables, and the same in DuckDB's SQL, which states the semantics on its own.

The tables are one file each, so logical partitions are made from keys (div and %). No table holds nulls: where their order
matters, some keys are made null on both sides.
"""

from __future__ import annotations

import datetime as dt
import uuid
import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import concat, from_dataframe, scan_parquet, write_metadata
from tessera.operators.dataset import Dataset
from tessera.plans.division import sampled
from tessera.sources.files import Files
from tessera.sources.parquet import ORD, PID
from tessera.sources.scratch import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: orders dealt to eight partitions by key, the customer null on every seventh.
O = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS c, o_totalprice AS p, o_orderkey % 8 AS pid FROM orders)"  # noqa: E741


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str, by: Column | None = None, n: int = 8, index=("c", "o_orderkey")) -> Dataset:
    key = F.col("o_orderkey")
    df = table(spark, d, "orders").select("o_orderkey", F.when(key % 7 == 0, None).otherwise(F.col("o_custkey")).alias("c"), F.col("o_totalprice").alias("p"))
    return from_dataframe(df, index, key % 8 if by is None else by, n)


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


def layout_rows(ds: Dataset, names: list[str], kinds: str) -> DataFrame:
    """The layout as rows: pid, n, lower and upper bounds."""
    rows = [(p, ds.sizes[p], *ds.lower_bounds[p], *ds.upper_bounds[p]) for p in range(len(ds))]
    cols = [f"lb_{n} {k}" for n, k in zip(names, kinds.split())] + [f"ub_{n} {k}" for n, k in zip(names, kinds.split())]
    return ds._spark.createDataFrame(rows, "pid long, n long, " + ", ".join(cols))


STATS = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY c NULLS FIRST, o_orderkey NULLS FIRST) AS a, row_number() OVER (PARTITION BY pid ORDER BY c DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS z FROM {O} {{where}})
SELECT CAST(row_number() OVER (ORDER BY pid) - 1 AS BIGINT) AS pid, count(*) AS n, max(c) FILTER (WHERE a = 1) AS lb_c, max(o_orderkey) FILTER (WHERE a = 1) AS lb_k, max(c) FILTER (WHERE z = 1) AS ub_c, max(o_orderkey) FILTER (WHERE z = 1) AS ub_k FROM t GROUP BY t.pid"""


@query(STATS.format(where=""))
def reindex_stats(spark, d):
    return layout_rows(orders(spark, d).reindex(), ["c", "k"], "long long")


@query(STATS.format(where="WHERE pid % 2 = 0"))
def reindex_drop_empty(spark, d):
    ds = orders(spark, d).map(lambda df: df.where(F.col("o_orderkey") % 2 == 0))
    return layout_rows(ds.reindex(), ["c", "k"], "long long")


@query(f"SELECT pid, count(*) AS n, CASE WHEN count(c) < count(*) THEN NULL ELSE min(c) END AS lb_c, max(c) AS ub_c FROM {O} GROUP BY pid")
def reindex_prefix(spark, d):
    return layout_rows(orders(spark, d).reindex().reindex("c"), ["c"], "long")


LB, UB = (200, 4000), (900, 9000)
GE = "(c > 200 OR (c = 200 AND o_orderkey {} 4000))".format
LT = "(c IS NULL OR c < 900 OR (c = 900 AND o_orderkey {} 9000))".format


def _slice(name: str, lb, ub, inclusive: str, where: str) -> None:
    def run(spark, d):
        return orders(spark, d).reindex().slice(lb, ub, inclusive).to_dataframe()

    run.__name__ = name
    query(f"SELECT o_orderkey, c, p FROM {O} WHERE {where}")(run)


_slice("slice_none", LB, UB, "none", f"{GE('>')} AND {LT('<')}")
_slice("slice_lower", LB, UB, "lower", f"{GE('>=')} AND {LT('<')}")
_slice("slice_upper", LB, UB, "upper", f"{GE('>')} AND {LT('<=')}")
_slice("slice_both", LB, UB, "both", f"{GE('>=')} AND {LT('<=')}")
_slice("slice_prefix", (200,), (900,), "both", "c BETWEEN 200 AND 900")
_slice("slice_open_lb", None, UB, "upper", LT("<="))
_slice("slice_open_ub", LB, None, "both", GE(">="))
_slice("slice_null_rows", None, (5,), "lower", "c IS NULL OR c < 5")
_slice("slice_null_bound", (None, 7000), (3, None), "lower", "(c IS NOT NULL OR o_orderkey >= 7000) AND (c IS NULL OR c < 3)")


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def slice_timestamp(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", "value")
    ds = from_dataframe(df, ["ts"], F.dayofmonth("ts") % 6, 6).reindex()
    return ds.slice((dt.datetime(2024, 1, 5, 6),), (dt.datetime(2024, 1, 20),)).to_dataframe()


@query("WITH b AS (SELECT o_orderkey // 700 AS q, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS BIGINT) AS pid, q AS old FROM b WHERE hi >= 300 AND lo < 1000")
def slice_pruned_partitions(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    ds = from_dataframe(df, ["o_orderkey"], F.floor(F.col("o_orderkey") / 700)).reindex()
    got = ds.slice((300,), (1000,))
    return got.to_dataframe("pid").groupBy("pid").agg(F.min(F.floor(F.col("o_orderkey") / 700)).alias("old")).select(F.col("pid").cast("long").alias("pid"), "old")


@query(f"SELECT o_orderkey AS key, c AS customer, p FROM {O} WHERE c >= 100")
def rename(spark, d):
    return orders(spark, d).reindex().rename({"c": "customer", "o_orderkey": "key"}).slice((100,)).to_dataframe()


def _two(spark, d) -> Dataset:
    return concat([orders(spark, d).reindex(), orders(spark, d, F.col("o_orderkey") % 3, 3).reindex()])


@query(f"SELECT o_orderkey, c, p FROM {O} UNION ALL SELECT o_orderkey, c, p FROM {O}")
def concatenate(spark, d):
    return _two(spark, d).to_dataframe()


@query(f"SELECT pid, count(*) AS n FROM {O} GROUP BY 1 UNION ALL SELECT 8 + o_orderkey % 3, count(*) FROM orders GROUP BY 1")
def concat_partition_sizes(spark, d):
    return spark.createDataFrame(list(enumerate(_two(spark, d).sizes)), "pid long, n long")


@query(f"SELECT o_orderkey, c, p, p * 2 AS twice FROM {O}")
def map_row_local(spark, d):
    return orders(spark, d).map(lambda df: df.withColumn("twice", F.col("p") * 2), preserves="all").to_dataframe()


@query(f"SELECT o_orderkey, c, p, p * 2 + 5 AS more FROM {O}")
def map_shared_args(spark, d):
    return orders(spark, d).map(lambda df, k, m: df.withColumn("more", F.col("p") * k + m), shared_args=[2, 5]).to_dataframe()


@query(f"SELECT o_orderkey, c, p, CAST(pid * 10 AS INTEGER) AS tag FROM {O}")
def map_extra_args(spark, d):
    return orders(spark, d).map(lambda df, tag: df.withColumn("tag", tag), extra_args=[[10 * k] for k in range(8)]).to_dataframe()


def _summary(part):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.table({"n": pa.array([len(part)]), "top": pa.array([pc.max(part.column("p")).as_py()], pa.float64())})


@query(f"SELECT pid, count(*) AS n, max(p) AS top FROM {O} GROUP BY pid")
def map_partition_agg(spark, d):
    return orders(spark, d).map(_summary, index_columns=(), rowwise=False).to_dataframe("pid").select(F.col("pid").cast("long").alias("pid"), "n", "top")


#: Orders, their key null on every eleventh, and line items summed up by order, their key null on every fifth: so both sides
#: have keys that the other lacks.
LEFT = "(SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey AS c FROM orders)"
RIGHT = "(SELECT CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_orderkey END AS k, count(*) AS lines FROM lineitem GROUP BY l_orderkey)"


def _sides(spark, d) -> tuple[Dataset, Dataset]:
    k = F.col("o_orderkey")
    left = table(spark, d, "orders").select(F.when(k % 11 == 0, None).otherwise(k).alias("k"), F.col("o_custkey").alias("c"))
    k = F.col("l_orderkey")
    right = table(spark, d, "lineitem").groupBy(k).agg(F.count("*").alias("lines")).select(F.when(k % 5 == 0, None).otherwise(k).alias("k"), "lines")
    deal = lambda n: F.coalesce(F.floor(F.col("k") / n), F.lit(0)) % 16
    return from_dataframe(left, ["k"], deal(1000), 16).reindex(), from_dataframe(right, ["k"], deal(1700), 16).reindex()


def _join(how: str, sql: str) -> None:
    def run(spark, d):
        left, right = _sides(spark, d)
        return left.join(right, how).to_dataframe()

    run.__name__ = f"join_{how}"
    query(sql)(run)


_join("inner", f"SELECT l.k, l.c, r.lines FROM {LEFT} l JOIN {RIGHT} r ON l.k = r.k")
_join("left", f"SELECT l.k, l.c, r.lines FROM {LEFT} l LEFT JOIN {RIGHT} r ON l.k = r.k")
_join("full", f"SELECT l.k, l.c, r.lines, r.k AS k_right FROM {LEFT} l FULL JOIN {RIGHT} r ON l.k = r.k")


@query(f"SELECT count(*) AS n, count(l.k) AS lefts, count(r.k) AS rights FROM {LEFT} l FULL JOIN {RIGHT} r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL")
def join_null_keys(spark, d):
    left, right = _sides(spark, d)
    df = left.join(right, "full").to_dataframe().where("k IS NULL OR k_right IS NULL")
    return df.agg(F.count("*").alias("n"), F.count("k").alias("lefts"), F.count("k_right").alias("rights"))


PART = "coalesce(k // {n}, 0) % 16"
LOWS = f"(SELECT CASE WHEN count(k) < count(*) THEN NULL ELSE min(k) END AS b FROM (SELECT k, {PART.format(n=1000)} AS q FROM {LEFT}) GROUP BY q UNION SELECT CASE WHEN count(k) < count(*) THEN NULL ELSE min(k) END FROM (SELECT k, {PART.format(n=1700)} AS q FROM {RIGHT}) GROUP BY q)"


@query(f"WITH d AS (SELECT DISTINCT b FROM {LOWS}), j AS (SELECT l.k FROM {LEFT} l LEFT JOIN {RIGHT} r ON l.k = r.k), p AS (SELECT (SELECT count(*) FROM d WHERE b IS NULL OR b <= j.k) AS pid FROM j) SELECT CAST(pid AS BIGINT) AS pid, count(*) AS n FROM p GROUP BY 1")
def join_partition_ids(spark, d):
    left, right = _sides(spark, d)
    return left.join(right, "left").to_dataframe("pid").groupBy(F.col("pid").cast("long").alias("pid")).agg(F.count("*").alias("n"))


CUM = f"SELECT c, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY c NULLS FIRST) AS BIGINT) // 1000 AS part FROM {O} GROUP BY c"


@query(f"SELECT CAST(row_number() OVER (ORDER BY part) - 1 AS BIGINT) AS pid, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(c) < count(*) THEN NULL ELSE min(c) END AS lb_c, max(c) AS ub_c FROM ({CUM}) GROUP BY part")
def repartition_index(spark, d):
    return layout_rows(orders(spark, d).repartition(1000, "c"), ["c"], "long")


@query(f"WITH q AS ({CUM}) SELECT o.o_orderkey, o.c, CAST(dense_rank() OVER (ORDER BY q.part) - 1 AS BIGINT) AS pid FROM {O} o JOIN q ON o.c IS NOT DISTINCT FROM q.c")
def repartition_index_rows(spark, d):
    return orders(spark, d).repartition(1000, "c").to_dataframe("pid").select("o_orderkey", "c", F.col("pid").cast("long").alias("pid"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def repartition_sampled(spark, d):
    ds = orders(spark, d).repartition(1000, "c", sample_fraction=0.1)
    return ds.to_dataframe().agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 1500 AS BIGINT) AS pid, event_id FROM events")
def repartition_rows(spark, d):
    df = table(spark, d, "events").select("event_id")
    ds = from_dataframe(df, (), F.floor(F.col("event_id") / 700), order_by="event_id")
    return ds.repartition(1500).to_dataframe("pid").select(F.col("pid").cast("long").alias("pid"), "event_id")


@query("""
WITH RECURSIVE s AS (SELECT row_number() OVER (ORDER BY min(o_orderkey)) AS i, count(*) AS n FROM orders GROUP BY o_orderkey // 700),
g AS (SELECT i, n, 0 AS pid, n AS held FROM s WHERE i = 1 UNION ALL SELECT s.i, s.n, CASE WHEN g.held >= 2000 THEN g.pid + 1 ELSE g.pid END, CASE WHEN g.held >= 2000 THEN s.n ELSE g.held + s.n END FROM g JOIN s ON s.i = g.i + 1)
SELECT CAST(pid AS BIGINT) AS pid, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")
def collate(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    ds = from_dataframe(df, ["o_orderkey"], F.floor(F.col("o_orderkey") / 700)).reindex().collate(2000)
    return ds.to_dataframe("pid").groupBy(F.col("pid").cast("long").alias("pid")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderkey // 700), b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_orderkey % 8)
SELECT (SELECT bool_and(ok) FROM (SELECT coalesce(hi < lead(lo) OVER (ORDER BY lo, hi), true) AS ok FROM a)) AS ranges, (SELECT bool_and(ok) FROM (SELECT coalesce(hi < lead(lo) OVER (ORDER BY lo, hi), true) AS ok FROM b)) AS remainders""")
def is_disjoint(spark, d):
    df = table(spark, d, "orders").select("o_orderkey")
    got = [from_dataframe(df, ["o_orderkey"], p).reindex().is_disjoint() for p in (F.floor(F.col("o_orderkey") / 700), F.col("o_orderkey") % 8)]
    return spark.createDataFrame([tuple(got)], "ranges boolean, remainders boolean")


@query(f"SELECT o_orderkey, c, p FROM {O} WHERE pid = 3")
def getitem_partition(spark, d):
    return orders(spark, d)[3]


@query(f"SELECT o_orderkey, c, p, CAST(pid AS BIGINT) AS pid FROM {O}")
def write_scan_roundtrip(spark, d):
    return orders(spark, d).write_parquet(folder(spark)).to_dataframe("pid").withColumn("pid", F.col("pid").cast("long"))


@query(f"SELECT o_orderkey, c, p, CAST(CASE WHEN c < 500 THEN 8 ELSE 0 END + pid AS BIGINT) AS pid FROM {O} WHERE c IS NOT NULL")
def append_roundtrip(spark, d):
    path, ds = folder(spark), orders(spark, d).reindex()
    high, low = (ds.map(lambda df, x=x: df.where(x)) for x in (F.col("c") >= 500, F.col("c") < 500))
    high.write_parquet(path)
    low.write_parquet(path, append=True)
    return scan_parquet(spark, path).to_dataframe("pid").withColumn("pid", F.col("pid").cast("long"))


@query("SELECT CAST(0 AS BIGINT) AS pid, count(*) AS n, min(o_orderkey) AS lb_k, max(o_orderkey) AS ub_k FROM orders")
def write_metadata_stats(spark, d):
    path = folder(spark)
    table(spark, d, "orders").coalesce(1).write.parquet(path)
    write_metadata(spark, path, ["o_orderkey"])
    return layout_rows(scan_parquet(spark, path), ["k"], "long")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def slice_timestamp_ltz(spark, d):
    """Instants in place of local times; the session's zone plays no part between the two ends."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = table(spark, d, "events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.lit("UTC")).alias("ts"), "value")
    ds = from_dataframe(df, ["ts"], F.dayofmonth("ts") % 6, 6).reindex()
    lb, ub = (dt.datetime(2024, 1, day, hour, tzinfo=zoneinfo.ZoneInfo(zone)) for day, hour in ((5, 6), (20, 0)))
    return ds.slice((lb,), (ub,)).to_dataframe().select("event_id", "value")


@query("SELECT o_orderkey, isnan(p) AS none FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS p FROM orders) WHERE p > 150000 OR isnan(p)")
def slice_nan(spark, d):
    """NaN comes after all numbers: partitions that end in it stay, and their rows are found in written files too."""
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select("o_orderkey", F.when(k % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("p"))
    ds = from_dataframe(df, ["p"], k % 8, 8).write_parquet(folder(spark))
    return ds.slice((150000.0,), None, "none").to_dataframe().select("o_orderkey", F.isnan("p").alias("none"))


@query("WITH b AS (SELECT o_orderkey // 700 AS q, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS BIGINT) AS pid, false AS sized, greatest(lo, 300) AS lb_k, least(hi, 2500) AS ub_k FROM b WHERE hi >= 300 AND lo < 2500")
def slice_layout(spark, d):
    """The layout of a slice: bounds no wider than asked for, sizes unknown where partitions are cut."""
    ds = from_dataframe(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], F.floor(F.col("o_orderkey") / 700)).reindex().slice((300,), (2500,))
    rows = [(p, ds.known_sizes, ds.lower_bounds[p][0], ds.upper_bounds[p][0]) for p in range(len(ds))]
    return spark.createDataFrame(rows, "pid long, sized boolean, lb_k long, ub_k long")


@query(STATS.format(where=""))
def map_preserves(spark, d):
    return layout_rows(orders(spark, d).reindex().map(lambda df: df.withColumn("twice", F.col("p") * 2), preserves="all"), ["c", "k"], "long long")


@query("SELECT o_orderkey, CAST(o_orderkey % 3 AS BIGINT) AS pid FROM orders")
def scan_foreign(spark, d):
    """Files of another writer, without a manifest, under names that need care."""
    path = folder(spark)
    files = Files(spark, path)
    files.fs.mkdirs(files.path)
    for k, name in enumerate(("a b.parquet", "c%20d.parquet", "e[1]+.parquet")):
        table(spark, d, "orders").where(F.col("o_orderkey") % 3 == k).select("o_orderkey").coalesce(1).write.parquet(f"{path}-{k}")
        made = Files(spark, f"{path}-{k}")
        part = next(n for n, _ in made.names() if n.startswith("part-"))
        made.fs.rename(made.at(part), files.at(name))
        made.delete()
    return scan_parquet(spark, path).to_dataframe("pid").select("o_orderkey", F.col("pid").cast("long").alias("pid"))


@query(f"WITH q AS ({CUM}) SELECT o.o_orderkey, o.c, CAST(dense_rank() OVER (ORDER BY q.part) - 1 AS BIGINT) AS pid FROM {O} o JOIN q ON o.c IS NOT DISTINCT FROM q.c")
def repartition_write(spark, d):
    ds = orders(spark, d).repartition(1000, "c").write_parquet(folder(spark))
    return ds.to_dataframe("pid").select("o_orderkey", "c", F.col("pid").cast("long").alias("pid"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY part) - 1 AS BIGINT) AS pid, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(c) < count(*) THEN NULL ELSE min(c) END AS lb_c, max(c) AS ub_c FROM ({CUM}) GROUP BY part")
def repartition_fraction_above_one(spark, d):
    """Fractions above 1 count all rows, so the layout is known."""
    return layout_rows(orders(spark, d).repartition(1000, "c", sample_fraction=2.0), ["c"], "long")


@query("SELECT CAST(o_orderkey % 8 AS BIGINT) AS pid, greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) AS n FROM orders GROUP BY 1")
def sample_sizes(spark, d):
    """The rows that a sampled repartition counts: an exact number of each partition, none twice."""
    some = sampled(orders(spark, d)._df, PID, ORD, 0.1, 10, 10)
    return some.groupBy(F.col(PID).cast("long").alias("pid")).agg(F.count_distinct("o_orderkey").alias("n"))


@query(f"SELECT o_orderkey, c, p FROM {O} WHERE c >= 500")
def overwrite_self(spark, d):
    path = folder(spark)
    orders(spark, d).reindex().write_parquet(path).slice((500,)).write_parquet(path)
    return scan_parquet(spark, path).to_dataframe()


@query("SELECT r_regionkey, r_name FROM region ORDER BY 1")
def collect_table(spark, d):
    return spark.createDataFrame(from_dataframe(table(spark, d, "region"), ["r_regionkey"]).collect())
