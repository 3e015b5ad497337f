"""Scan and write datasets: one folder for each partition beside a manifest; or foreign folders of Parquet files."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import AppendError
from tessera.plans.layout import Layout
from tessera.plans.stats import looked_up, partition_stats
from tessera.sources import codec
from tessera.sources.files import Files

PID, ORD = "__pid", "__ord"
ORDER = T.ArrayType(T.LongType())
MANIFEST = "_tessera.json"  # Spark's listing passes over names that begin so
FEW = 16  # so many names are told apart by a chain of comparisons, more by a join


def load_manifest(files: Files) -> dict:
    """The manifest of a folder, its bounds as values. FileNotFoundError without one."""
    if not files.exists(MANIFEST):
        raise FileNotFoundError(f"no manifest in {files.path}")
    m = json.loads(files.read(MANIFEST))
    m["schema"] = T.StructType.fromJson(m["schema"])
    kinds = [m["schema"][c].dataType for c in m["index_columns"]]
    for side in ("lower", "upper"):
        m[side] = codec.decode_all(m[side], kinds)
    if not len(m["parts"]) == len(m["sizes"]) == len(m["lower"]) == len(m["upper"]):
        raise ValueError(f"the manifest of {files.path} doesn't hold together")
    return m


def layout_of(m: dict) -> Layout:
    return Layout(len(m["parts"]), tuple(m["index_columns"]), tuple(m["sizes"]), m["lower"], m["upper"])


def save_manifest(files: Files, layout: Layout, parts: list, schema: T.StructType, last: int, foreign: bool) -> None:
    kinds = [schema[c].dataType for c in layout.index_columns]
    lower, upper = (codec.encode_all(b, kinds) for b in (layout.lower, layout.upper))
    said = {"version": 2, "foreign": foreign, "index_columns": layout.index_columns, "parts": parts, "sizes": layout.sizes, "lower": lower, "upper": upper, "last_part": last, "schema": json.loads(schema.json())}
    files.write(MANIFEST, json.dumps(said, indent=1))


def _numbered(spark: SparkSession, df: DataFrame, name: Column, names: list, all_: bool) -> DataFrame:
    """df with PID: the place of `name` in names. Rows of other names are left out, or are an error where all are wanted."""
    if len(names) <= FEW:
        place = F.lit(None).cast("int")
        for i, n in reversed(list(enumerate(names))):
            place = F.when(name == n, i).otherwise(place)
        df = df.withColumn(PID, place)
    else:
        table = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField(PID, T.IntegerType()), T.StructField("__name", T.IntegerType() if isinstance(names[0], int) else T.StringType())]))
        df = df.withColumn("__name", name).join(looked_up(table, len(names)), "__name", "left").drop("__name")
    if not all_:
        return df.where(F.col(PID).isNotNull())
    return df.withColumn(PID, F.coalesce(PID, F.raise_error(F.concat(F.lit("a file that wasn't listed: "), name)).cast("int")))


def _ord(*parts: Column) -> Column:
    """The order key of a row in its partition: longs that are compared one after the other."""
    return F.array(*(p.cast("long") for p in parts))


def _read_foreign(spark: SparkSession, files: Files, names: list[str], schema: T.StructType | None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*(re.sub(r"([\\{}\[\]*?])", r"\\\1", files.at(n).toString()) for n in names))
    df = df.withColumns({ORD: _ord(F.col("_metadata.row_index")), "__file": F.col("_metadata.file_name")})
    return _numbered(spark, df, F.col("__file"), [files.encoded(n) for n in names], True).drop("__file")


def scan_parquet(spark: SparkSession, path: str):
    """Lazily open a folder. With a manifest, its partitions and statistics; without, each *.parquet file in it is a partition,
    in order of names, an empty file too. FileNotFoundError where there are no files."""
    from tessera.operators.dataset import Dataset

    files = Files(spark, path)
    if not files.exists(MANIFEST):
        names = [n for n, folder in files.names() if n.endswith(".parquet") and not folder and n[0] not in "._"]
        if not names:
            raise FileNotFoundError(f"no Parquet files in {path}")
        return Dataset(_read_foreign(spark, files, names, None), Layout(len(names)))
    m = load_manifest(files)
    schema, layout = m["schema"], layout_of(m)
    hidden = T.StructType([*schema.fields, T.StructField(ORD, ORDER), T.StructField(PID, T.IntegerType())])
    if not m["parts"]:
        return Dataset(spark.createDataFrame([], hidden), layout)
    if m["foreign"]:
        return Dataset(_read_foreign(spark, files, m["parts"], schema), layout)
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(PID, T.IntegerType())])).parquet(path)
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)  # a partition's files are numbered in its order
    df = df.withColumn(ORD, _ord(file, F.col("_metadata.row_index")))
    if m["parts"] != list(range(len(m["parts"]))):
        df = _numbered(spark, df.where(F.col(PID).isin(m["parts"])).withColumnRenamed(PID, "__part"), F.col("__part"), m["parts"], False).drop("__part")
    else:  # folders of a failed append are not in the manifest
        df = df.where(F.col(PID) < len(m["parts"]))
    return Dataset(df, layout)


def _put(ds, path: str, offset: int, mode: str) -> tuple[list[int], Layout]:
    """Write the partitions that have rows to folders offset + pid; their numbers and layout."""
    df = ds._df.withColumn(PID, (F.col(PID) + offset).cast("int"))
    # ranges of rows in their order: a large partition gets several files, and many small ones share a task
    df = df.repartitionByRange(PID, ORD).sortWithinPartitions(PID, ORD).drop(ORD)
    df.write.mode(mode).option("compression", "zstd").partitionBy(PID).parquet(path)
    if ds.known_sizes and ds.known_bounds:
        keep = [p for p, s in enumerate(ds.sizes) if s]
        return [p + offset for p in keep], ds._layout.pick(keep)
    stats = partition_stats(ds._spark.read.schema(T.StructType([*ds._public.fields, T.StructField(PID, T.IntegerType())])).parquet(path).where(F.col(PID) >= offset), PID, ds.index_columns) if len(ds) else []
    return [s[0] for s in stats], Layout(len(stats), ds.index_columns, tuple(s[1] for s in stats), tuple(s[2] for s in stats), tuple(s[3] for s in stats))


def write_dataset(ds, path: str, append: bool):
    """Write to a neighbour and swap it in, so that a dataset may replace its own source; or append and swap the manifest."""
    spark, target = ds._spark, Files(ds._spark, path)
    if not append:
        beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        stage = Files(spark, f"{beside}.stage")
        try:
            parts, layout = _put(ds, str(stage.path), 0, "errorifexists")
            save_manifest(stage, layout, parts, ds._public, len(ds) - 1, False)
            target.replace_by(stage, Files(spark, f"{beside}.old"))
        except BaseException:
            stage.delete()
            raise
        return scan_parquet(spark, path)
    try:
        m = load_manifest(target)
    except FileNotFoundError as e:
        raise AppendError(f"no dataset to append to at {path}") from e
    if m["foreign"]:
        raise AppendError("can't append to a folder of foreign files")
    if tuple(m["index_columns"]) != ds.index_columns:
        raise AppendError("the index columns differ")
    old = m["schema"]
    if m["parts"] and [(f.name, f.dataType) for f in old] != [(f.name, f.dataType) for f in ds._public]:
        raise AppendError("the schemas differ")
    there = [int(n.split("=")[1]) for n, folder in target.names() if folder and n.startswith(f"{PID}=") and n.split("=")[1].isdigit()]
    offset = max([m["last_part"], *there], default=-1) + 1
    parts, layout = _put(ds, path, offset, "append")
    before = layout_of(m)
    join = lambda k: tuple(getattr(before, k)) + tuple(getattr(layout, k))
    save_manifest(target, Layout(before.npartitions + layout.npartitions, ds.index_columns, join("sizes"), join("lower"), join("upper")), m["parts"] + parts, ds._public if not m["parts"] else old, offset + len(ds) - 1, False)
    return None


def write_metadata(spark: SparkSession, path: str, index_columns=(), parallel=False, progress=False) -> None:
    """Add a manifest to a folder of Parquet files, in place of any that it has; empty files are left out of it."""
    from tessera.progress import Progress, workers

    workers(parallel)
    files = Files(spark, path)
    names = [n for n, folder in files.names() if n.endswith(".parquet") and not folder and n[0] not in "._"]
    if not names:
        raise FileNotFoundError(f"no Parquet files in {path}")
    index_columns = (index_columns,) if isinstance(index_columns, str) else tuple(index_columns)
    df = _read_foreign(spark, files, names, None)
    with Progress(spark, progress):
        stats = partition_stats(df, PID, index_columns)
    layout = Layout(len(stats), index_columns, tuple(s[1] for s in stats), tuple(s[2] for s in stats), tuple(s[3] for s in stats))
    save_manifest(files, layout, [names[s[0]] for s in stats], T.StructType([f for f in df.schema if f.name not in (PID, ORD)]), len(names) - 1, True)
