"""The dataset operators against plain Python over the same rows: shelves of goods, with nulls, NaN and repeated keys."""

import datetime as dt
import decimal
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import AppendError, DecodingError, StatsUnknownError, concat, from_dataframe, scan_parquet, write_metadata
from tessera.functions import lex_cmp, lex_key, nullable_cmp, sort_partitions
from tessera.functions.order import instant
from tessera.plans.division import row_divisions, sampled
from tessera.progress import Progress, make_progress_callback, workers
from tessera.sources import codec
from tessera.sources.files import Files

SCHEMA = "aisle string, weight double, best date, item long"
NAN = float("nan")
DAY = dt.date(2031, 5, 1)


def goods():
    out = []
    for k in range(61):
        aisle = None if k % 13 == 5 else "bcd"[k * k % 3] + "xy"[k % 2]
        weight = None if k % 17 == 3 else NAN if k % 11 == 7 else (k * 37 % 19) / 4
        out.append((aisle, weight, DAY + dt.timedelta(days=k % 7), k))
    return out


ROWS = goods()
PARTS = 5


@pytest.fixture(scope="session")
def shelf(spark):
    return from_dataframe(spark.createDataFrame(ROWS, SCHEMA), partition_ids=F.col("item") % PARTS, npartitions=PARTS)


def plain(row):
    return tuple("nan" if isinstance(v, float) and v != v else v for v in row)


def rows(x):
    return Counter(plain(r) for r in (x.to_dataframe() if hasattr(x, "to_dataframe") else x).collect())


def bag(some):
    return Counter(map(plain, some))


def key(row, n=2):
    return tuple(row[:n])


def check(ds):
    """The layout says what the rows say."""
    for i, part in enumerate(ds):
        got = part.collect()
        if ds.known_sizes:
            assert len(got) == ds.sizes[i]
        if ds.known_bounds and ds.index_columns and got:
            kinds = [ds.schema[c] for c in ds.index_columns]
            keys = sorted((tuple(instant(r[c], k) for c, k in zip(ds.index_columns, kinds)) for r in got), key=lex_key)
            assert lex_cmp(ds.lower_bounds[i], keys[0]) <= 0 <= lex_cmp(ds.upper_bounds[i], keys[-1])
    return ds


def test_order():
    line = [None, float("-inf"), -1.0, 0.0, 7.5, float("inf"), NAN]
    for i, a in enumerate(line):
        for j, b in enumerate(line):
            assert nullable_cmp(a, b) == (i > j) - (i < j)
    assert lex_cmp(("b", None), ("b", 1)) == -1 and lex_cmp((), ()) == 0 and lex_cmp((NAN, 2), (NAN, 1)) == 1
    with pytest.raises(ValueError):
        lex_cmp((1,), (1, 2))
    assert sort_partitions([(3,), (None,), (3,)], [(NAN,), (9,), (5,)]) == [1, 2, 0]


def test_reindex(spark, shelf):
    assert len(shelf) == PARTS and not shelf.known_sizes and shelf.lower_bounds == ((),) * PARTS
    ds = check(shelf.reindex(["aisle", "weight"]))
    for p in range(PARTS):
        keys = sorted((key(r) for r in ROWS if r[3] % PARTS == p), key=lex_key)
        assert ds.sizes[p] == len(keys) and lex_cmp(ds.lower_bounds[p], keys[0]) == 0 == lex_cmp(ds.upper_bounds[p], keys[-1])
    assert any(b[1] != b[1] for b in check(shelf.reindex(["item", "weight"])).upper_bounds) or ds.reindex(["aisle", "weight"]) is ds
    assert ds.reindex(["aisle"]).lower_bounds == tuple(b[:1] for b in ds.lower_bounds)
    late = shelf.reindex(["item"], collect_stats=False)
    assert not late.known_bounds and len(late) == PARTS
    for call in (late.is_disjoint, late.assert_disjoint):
        with pytest.raises(StatsUnknownError):
            call()
    with pytest.raises(ValueError):
        shelf.reindex(["nope"])
    with pytest.raises(AssertionError):
        ds.assert_disjoint()


def test_prefix_reindex_reads_nothing(shelf):
    ds = shelf.reindex(["aisle", "weight"])
    ds._df = ds._df.where(F.raise_error(F.lit("read")).isNull())
    assert ds.reindex(["aisle"]).sizes == ds.sizes


def test_all_null_suffix_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "x int, y int")
    assert from_dataframe(df, ["x", "y"]).upper_bounds == ((1, None),)
    none = from_dataframe(df.where("x > 1"), ["x"])
    assert len(none) == 0 and none.reindex(["y"]).sizes == () and none.repartition(3) is none
    assert len(from_dataframe(df.where("x > 1"))) == 1


BOUNDS = [(("bx", 1.0), ("cy", 2.5)), ((None, None), ("bx", None)), (None, ("cx",)), (("cx",), None), (("bx", None), None), ((None, -3.0), ("bx", NAN)), (("dx",), ("bx",)), (None, (None,)), (("bx", NAN), None), (None, ("dy", NAN))]


@pytest.mark.parametrize("inclusive", ["none", "lower", "upper", "both"])
def test_slice(shelf, inclusive):
    ds = shelf.reindex(["aisle", "weight"])
    low, up = inclusive in ("lower", "both"), inclusive in ("upper", "both")
    for lb, ub in BOUNDS:
        got = check(ds.slice(lb, ub, inclusive))
        want = [r for r in ROWS if (lb is None or lex_cmp(lb, key(r, len(lb))) < low) and (ub is None or lex_cmp(key(r, len(ub)), ub) < up)]
        assert rows(got) == bag(want)
        if got.known_sizes:
            assert sum(got.sizes) == len(want)


@pytest.mark.parametrize("writer", ["spark", "arrow"])
def test_slice_keeps_nan(spark, tmp_path, writer):
    """Parquet's statistics leave NaN out; rows with it must be found all the same, whoever wrote the files."""
    values = [1.0, 7.0, NAN]
    if writer == "spark":
        ds = from_dataframe(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), ["x"]).write_parquet(str(tmp_path / "d"))
    else:
        pq.write_table(pa.table({"x": values}), tmp_path / "d.parquet")
        write_metadata(spark, str(tmp_path), ["x"])
        ds = scan_parquet(spark, str(tmp_path))
    assert ds.upper_bounds[0][0] != ds.upper_bounds[0][0]
    assert rows(ds.slice((5.0,), None, "none")) == Counter([(7.0,), ("nan",)]) and rows(ds.slice((NAN,), None)) == Counter([("nan",)])
    assert rows(ds.slice(None, (NAN,), "none")) == Counter([(1.0,), (7.0,)]) and rows(ds.slice((7.0,), (NAN,), "both")) == Counter([(7.0,), ("nan",)])


def test_slice_prunes_and_checks(spark, shelf, tmp_path):
    ds = from_dataframe(spark.createDataFrame(ROWS, SCHEMA), ["item"], F.floor(F.col("item") / 10), 7).reindex()
    assert len(ds.slice((20,), (30,))) == 1 and len(ds.slice((20,), (30,), "both")) == 2
    back = ds.write_parquet(str(tmp_path / "d"))
    plan = back.slice((23,), (37,)).to_dataframe().select("item")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(item,23)" in plan and "LessThan(item,37)" in plan and "ReadSchema: struct<item:bigint" in plan and "aisle" not in plan
    assert "__pid" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert rows(back.slice((23,), (37,))) == bag(r for r in ROWS if 23 <= r[3] < 37)
    for bad in (dict(inclusive="x"), dict(lb=(1, 2, 3))):
        with pytest.raises(ValueError):
            ds.slice(**bad)
    with pytest.raises(ValueError):
        shelf.reindex(["item"], collect_stats=False).slice((1,))


def test_instants(spark, tmp_path):
    """Keys of the type timestamp, with a session zone other than Python's: layouts, slices and files agree."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = [dt.datetime(2031, 3, 9, 4, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=20 * k) for k in range(48)]  # over a change of clocks
        df = spark.createDataFrame([(k, int(t.timestamp())) for k, t in enumerate(at)], "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
        ds = check(from_dataframe(df, ["t"]).repartition(10))
        assert [p.count() for p in ds] == list(ds.sizes) == [9, 10, 10, 10, 9]
        assert ds.lower_bounds[0] == (at[0],) and ds.upper_bounds[-1] == (at[-1],)
        back = ds.write_parquet(str(tmp_path / "t"))
        assert back.lower_bounds == ds.lower_bounds
        got = back.slice((at[7],), (at[29].astimezone(dt.timezone(dt.timedelta(hours=9))),), "both").to_dataframe().collect()
        assert sorted(r["k"] for r in got) == list(range(7, 30))
        assert back.slice((at[40].astimezone().replace(tzinfo=None),)).to_dataframe().count() == 8  # without a zone: Python's own
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_repartition_by_key(shelf):
    ds = check(shelf.repartition(12, ["best"]))
    counts = Counter(r[2] for r in ROWS)
    run, want = 0, Counter()
    for day in sorted(counts):
        run += counts[day]
        want[run // 12] += counts[day]
    assert ds.sizes == tuple(want[k] for k in sorted(want)) and rows(ds) == bag(ROWS) and ds.is_disjoint()
    some = check(shelf.repartition(12, ["best"], sample_fraction=0.5))
    assert not some.known_sizes and rows(some) == bag(ROWS)
    assert shelf.repartition(12, ["best"], sample_fraction=3).sizes == ds.sizes
    assert check(shelf.reindex(["item"]).repartition(10)).assert_disjoint() is not None
    assert rows(check(shelf.repartition(10, ["weight", "aisle"]))) == bag(ROWS)


def test_hot_key(spark):
    """The key with two thirds of the rows fills the parts that it passes at once."""
    df = spark.range(90).select(F.when(F.col("id") < 60, -1).otherwise(F.col("id")).alias("k"))
    assert from_dataframe(df, ["k"]).repartition(15).sizes == (74, 15, 1)


def test_sample_is_exact(spark):
    """As many rows of each partition as asked for, none twice, equal rows apart, and the same again for a seed."""
    df = spark.range(20_000).select(F.lit(1).alias("v"), "id")
    ds = from_dataframe(df, partition_ids=F.when(F.col("id") < 19_000, 0).otherwise(F.when(F.col("id") < 19_997, 1).otherwise(2)), npartitions=3)
    take = lambda f, seed: {(r["__pid"], r["id"]) for r in sampled(ds._df, "__pid", "__ord", f, seed, 10).collect()}
    a = take(0.1, 10)
    assert Counter(p for p, _ in a) == {0: 1900, 1: 99, 2: 1} and a == take(0.1, 10) != take(0.1, 11)
    assert Counter(p for p, _ in take(0.999, 3)) == {0: 18981, 1: 996, 2: 2}


def test_repartition_by_rows(spark, shelf):
    ds = check(shelf.repartition(25))
    assert ds.sizes == (25, 25, 11) and rows(ds) == bag(ROWS)
    for sizes, n in (([4, 1, 9, 2], 6), ([7, 7], 7), ([1, 1, 1], 5), ([6], 4)):
        cuts, parts = row_divisions(sizes, n)
        ends = [sum(sizes[:p]) + off for p, off in cuts]
        assert ends == list(range(n, sum(sizes), n)) and sum(parts) == sum(sizes) and all(off < sizes[p] for p, off in cuts)
    ordered = from_dataframe(spark.createDataFrame(ROWS, SCHEMA).repartition(7), order_by=["weight", "item"]).repartition(20)
    want = sorted(ROWS, key=lambda r: lex_key((r[1], r[3])))
    assert [r["item"] for p in ordered for r in sorted(p.collect(), key=lambda r: lex_key((r[1], r[3])))] == [r[3] for r in want]


#: The published example of cutting by rows: sizes, rows a part, cuts and parts (fixed values).
def test_repartition_by_rows_of_many_ranges(spark):
    """A sort draws the ranges of its tasks anew in every job; the rows are numbered as they were counted all the same."""
    odd = {"none": F.lit(None), "span": F.make_interval(days=F.col("id") % 9)}
    df = spark.range(60_000, numPartitions=6).select((F.col("id") * 7919 % 60_000).alias("id")).withColumns(odd)
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        ds = from_dataframe(df, (), F.floor(F.col("id") / 700), order_by="id").repartition(1500)
        got = ds.to_dataframe("pid").selectExpr("count(*)", "count(distinct id)", "count_if(pid = id div 1500)", "count_if(none is null)", "count_if(string(span) = string(make_interval(0, 0, 0, id % 9)))")
        assert tuple(got.first()) == (60_000,) * 5
    finally:
        spark.conf.unset(merged)


def test_row_divisions_golden():
    assert row_divisions([3, 5, 2, 7], 5) == ([(1, 2), (3, 0), (3, 5)], [5, 5, 5, 2])


def test_collate(spark, shelf):
    ds = from_dataframe(spark.createDataFrame(ROWS, SCHEMA), ["item"], F.floor(F.col("item") / 8), 8).reindex().collate(20)
    assert check(ds).sizes == (24, 24, 13) and rows(ds) == bag(ROWS)
    nan = shelf.reindex(["weight"]).collate(100)
    assert nan.upper_bounds[0][0] != nan.upper_bounds[0][0] and check(nan).sizes == (61,)
    with pytest.raises(ValueError):
        shelf.collate(3)


def test_order_keys_of_many_tasks(spark, tmp_path):
    """Rows of more than 2048 Spark partitions stay in order through collating, repartitioning and files."""
    df = spark.range(0, 6000, 1, 3000).withColumnRenamed("id", "k")
    ds = from_dataframe(df, ["k"], F.floor(F.col("k") / 3000), 2).reindex().collate(6000)
    assert ds.collect().column("k").to_pylist() == list(range(6000))
    assert ds.collate(10).repartition(6000, "k").collect().column("k").to_pylist() == list(range(6000))
    assert ds.repartition(2500, ()).write_parquet(str(tmp_path / "d")).collect().column("k").to_pylist() == list(range(6000))
    got = ds.map(lambda t: t.slice(0, 2500), rowwise=False).collect()
    assert got.column("k").to_pylist() == list(range(2500))


def test_rename_concat_map(spark, shelf):
    ds = shelf.reindex(["aisle"])
    r = ds.rename({"aisle": "where"})
    assert r.index_columns == ("where",) and r.lower_bounds == ds.lower_bounds and "where" in r.schema
    with pytest.raises(ValueError):
        ds.rename({"x": "y"})
    both = check(concat([ds, concat([], spark=spark), ds]))
    assert both.sizes == ds.sizes * 2 and rows(both) == rows(ds) + rows(ds) and not both.is_disjoint()
    for bad in ([ds, r], [ds, 3], 5, [ds, ds.map(lambda df: df.withColumn("z", F.lit(1)))]):
        with pytest.raises(ValueError):
            concat(bad)
    m = ds.map(lambda df, k: df.withColumn("more", F.col("item") * k), shared_args=[3], preserves="all")
    assert m.sizes == ds.sizes and all(x["more"] == 3 * x["item"] for x in m.to_dataframe().collect())
    assert ds.map(lambda df: df, preserves="sizes").sizes == ds.sizes and not ds.map(lambda df: df, preserves="sizes").known_bounds
    assert ds.map(lambda df: df, preserves="bounds").lower_bounds == ds.lower_bounds and not ds.map(lambda df: df, preserves="bounds").known_sizes
    e = ds.map(lambda df, k: df.withColumn("b", k), extra_args=[[i * i] for i in range(PARTS)])
    assert not e.known_bounds and Counter(x["b"] for x in e.to_dataframe().collect()) == {i * i: n for i, n in enumerate(ds.sizes)}
    for bad in (dict(preserves="x"), dict(preserves="all", index_columns=["item"]), dict(extra_args=[[1]])):
        with pytest.raises(ValueError):
            ds.map(lambda df: df, **bad)


def test_map_tables(spark, shelf):
    sums = shelf.reindex().map(lambda t, k, m: pa.table({"n": pa.array([len(t) * k + m])}), extra_args=[[2]] * PARTS, shared_args=[5], rowwise=False)
    assert sorted(r["n"] for r in sums.to_dataframe().collect()) == sorted(2 * n + 5 for n in shelf.reindex().sizes)
    empty = from_dataframe(spark.range(0)).map(lambda t: pa.table({"n": pa.array([len(t)])}), rowwise=False)
    assert empty.to_dataframe().collect()[0]["n"] == 0
    cast = shelf.map(lambda df: df.select("item", "__pid", "__ord"), schema={"item": T.StringType()})
    assert {r["item"] for r in cast.to_dataframe().collect()} == {str(r[3]) for r in ROWS}


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_join(spark, shelf, how):
    left = shelf.reindex(["aisle"])
    names = spark.createDataFrame([("bx", 1), ("dy", 2), ("zz", 3), (None, 4)], "aisle string, clerk long")
    right = from_dataframe(names, ["aisle"], F.col("clerk") % 2, 2).reindex()
    ds = left.join(right, how)
    want = left.to_dataframe().alias("l").join(names.alias("r"), F.col("l.aisle") == F.col("r.aisle"), how)
    want = want.select("l.*", "clerk", *([F.col("r.aisle").alias("aisle_right")] if how == "full" else []))
    assert rows(ds) == rows(want) and ds.to_dataframe().columns == want.columns
    assert len(ds) == len(set(left.lower_bounds) | set(right.lower_bounds)) + 1 and not ds.known_sizes
    assert sum(p.count() for p in ds) == want.count()
    for other, h in ((right.rename({"clerk": "item"}), "inner"), (right, "outer"), (3, "inner"), (right.rename({"aisle": "d"}), "inner"), (right.reindex(["aisle"], collect_stats=False).rename({"clerk": "x"}), "sideways")):
        with pytest.raises(ValueError):
            left.join(other, h)
    with pytest.raises(ValueError):
        left.join(shelf.reindex(["aisle"], collect_stats=False).rename({c: f"{c}2" for c in ("weight", "best", "item")}))


def test_io(spark, shelf, tmp_path):
    ds, path = shelf.reindex(["aisle", "best"]), str(tmp_path / "ds")
    back = check(ds.write_parquet(path))
    assert back._layout == ds._layout and rows(back) == rows(ds) and back.schema == ds.schema
    assert back.collect().column("item").to_pylist() == ds.collect().column("item").to_pylist()
    again = back.slice(("cx",)).write_parquet(path)  # over its own source
    assert rows(again) == bag(r for r in ROWS if r[0] and r[0] >= "cx") and sorted(p.name for p in tmp_path.iterdir()) == ["ds"]
    assert ds.slice(None, ("cx",)).write_parquet(path, append=True) is None
    assert rows(check(scan_parquet(spark, path))) == bag(ROWS)
    with pytest.raises(AppendError):
        ds.write_parquet(str(tmp_path / "no"), append=True)
    with pytest.raises(AppendError):
        ds.reindex(["item"]).write_parquet(path, append=True)
    with pytest.raises(AppendError):
        ds.map(lambda df: df.withColumn("z", F.lit(1)), preserves="all").write_parquet(path, append=True)
    with pytest.raises(IndexError):
        ds[PARTS]
    assert ds[-1].count() == ds.sizes[-1]
    none = from_dataframe(spark.createDataFrame([], SCHEMA), ["item"]).write_parquet(str(tmp_path / "none"))
    assert len(none) == 0 and none.collect().num_rows == 0 and none.schema == ds.schema
    from_dataframe(spark.createDataFrame(ROWS, SCHEMA), ["item"]).write_parquet(str(tmp_path / "none"), append=True)
    assert scan_parquet(spark, str(tmp_path / "none")).sizes == (61,)


def test_repartitioned_write(spark, tmp_path):
    """Repartitioned datasets in files: by key, by rows, one partition in several files, with and without an index."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    ds = from_dataframe(df, ["k"], F.col("id") % 6 if "id" in df.columns else F.col("v") % 6, 6)
    by_key = check(ds.repartition(700).write_parquet(str(tmp_path / "k")))
    assert sum(by_key.sizes) == 5000 and by_key.is_disjoint() and scan_parquet(spark, str(tmp_path / "k")).sizes == by_key.sizes
    by_rows = check(from_dataframe(df, order_by="v").repartition(1300).write_parquet(str(tmp_path / "r")))
    assert by_rows.sizes == (1300, 1300, 1300, 1100) and by_rows.collect().column("v").to_pylist() == list(range(5000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows come together again
    try:
        one = from_dataframe(df, order_by="v").write_parquet(str(tmp_path / "one"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "one" / "__pid=0").glob("part-*"))) > 1 and one.collect().column("v").to_pylist() == list(range(5000))


def test_failed_overwrite_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ds")
    ds = from_dataframe(spark.range(5), ["id"]).write_parquet(path)
    move = Files.move_to

    def fails(self, other):
        if str(self.path).endswith(".stage"):
            raise OSError("no")
        move(self, other)

    monkeypatch.setattr(Files, "move_to", fails)
    with pytest.raises(OSError):
        ds.slice((3,)).write_parquet(path)
    assert rows(scan_parquet(spark, path)) == rows(spark.range(5)) and [p.name for p in tmp_path.iterdir()] == ["ds"]


def test_failed_append_stays_unseen(spark, tmp_path):
    path = str(tmp_path / "ds")
    ds = from_dataframe(spark.range(5), ["id"]).write_parquet(path)
    ds._df.withColumn("__pid", F.lit(1)).drop("__ord").write.mode("append").partitionBy("__pid").parquet(path)  # no manifest
    assert rows(scan_parquet(spark, path)) == rows(spark.range(5))
    from_dataframe(spark.range(5, 7), ["id"]).write_parquet(path, append=True)
    assert scan_parquet(spark, path).sizes == (5, 2) and rows(scan_parquet(spark, path)) == rows(spark.range(7))


@pytest.mark.parametrize("names", [["0", "1", "2"], ["a b", "c%d", "e%20f"], ["x[1]", "y{2}+", "zé?"], [f"n{k:02d}" for k in range(20)]])
def test_foreign_folder(spark, tmp_path, names):
    parts = [[1, 2], [], [None, 3]] + [[k] for k in range(9, 9 + len(names) - 3)]
    for name, part in zip(names, parts):
        pq.write_table(pa.table({"x": pa.array(part, pa.int64())}), tmp_path / f"{name}.parquet")
    ds = scan_parquet(spark, str(tmp_path))
    assert len(ds) == len(names) and not ds.known_sizes and ds[1].count() == 0 and ds.collect().column("x").to_pylist() == [x for p in parts for x in p]
    write_metadata(spark, str(tmp_path), ["x"])
    ds = check(scan_parquet(spark, str(tmp_path)))
    assert ds.sizes[:2] == (2, 2) and ds.lower_bounds[:2] == ((1,), (None,)) and ds.upper_bounds[:2] == ((2,), (3,)) and len(ds) == len(names) - 1
    assert ds.collect().num_rows == sum(map(len, parts))
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        scan_parquet(spark, str(tmp_path / "empty"))


def test_codec():
    zone = dt.timezone(dt.timedelta(hours=-3))
    values = [(True, "boolean"), (5, "bigint"), ("x", "string"), (None, "double"), (2.5, "double"), (NAN, "double"), (float("-inf"), "float"), (dt.date(1960, 2, 29), "date"), (dt.datetime(1950, 1, 1, 5, 6, 7, 8), "timestamp_ntz"), (dt.datetime(2031, 1, 1, 5, tzinfo=zone), "timestamp"), (dt.timedelta(days=-2, seconds=3, microseconds=4), "interval day to second"), (decimal.Decimal("1.20"), "decimal(5,2)"), (b"\x00\xff", "binary")]
    for value, kind in values:
        kind = T.StructType.fromDDL(f"v {kind}")["v"].dataType
        x = codec.encode(value, kind)
        assert x is None or type(x) in (bool, int, float, str)
        back = codec.decode(x, kind)
        assert nullable_cmp(back, value) == 0 and type(back) is type(value)
    for x, kind in (("x", T.DateType()), ([], T.DecimalType()), (3, T.StringType()), ("zz", T.BinaryType())):
        with pytest.raises(DecodingError):
            codec.decode(x, kind)
    with pytest.raises(TypeError):
        codec.encode(object(), T.StringType())


def test_progress(spark, shelf, capsys):
    now = dt.datetime(2031, 1, 1)
    call = make_progress_callback("{completed}/{total} {percent} {remaining} {telapsed} {tremaining} {ttotal} {start} {now} {finish}")
    call(1, 4, now + dt.timedelta(minutes=10), now)
    assert capsys.readouterr().out == "1/4 25 3 0:10:00 0:30:00 0:40:00 2031-01-01 00:00:00 2031-01-01 00:10:00 2031-01-01 00:40:00\n"
    every = make_progress_callback(("{completed}", 3))
    for k in range(1, 8):
        every(k, 7, now, now)
    assert capsys.readouterr().out == "3\n6\n"
    for bad in (0, -1, ("x",), 1.5, (3, 3), ("x", True), ("x", 0), None):
        with pytest.raises(ValueError):
            make_progress_callback(bad)
    seen = []
    shelf.reindex(["item"], progress=lambda *a: seen.append(a[:2]))
    assert [s[0] for s in seen] == list(range(1, len(seen) + 1)) and seen[-1][0] == seen[-1][1] > 1
    with pytest.raises(ZeroDivisionError), Progress(spark, lambda *a: None):
        1 / 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert workers(False) == workers(0) == workers(1) == 1 and workers(3) == 3 and workers(True) >= 1 and workers(-10_000) == 1
    with pytest.raises(ValueError):
        workers("x")


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
