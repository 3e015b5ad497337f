"""Tables on the way: written to the folder that driver and executors share, so that no lost executor changes them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import Files

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where it is unset."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said and not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return (said or _own[0]).rstrip("/")


@contextlib.contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """df as a written table, which is deleted at the end of the block."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        Files(spark, path).delete()


def kept(df: DataFrame) -> DataFrame:
    """df as a written table that stays, for results that are read later. Voids and calendar intervals, which Parquet can't
    hold, travel as text."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    odd = {f.name: f.dataType.simpleString() for f in df.schema if f.dataType.simpleString() in ("void", "interval")}
    out = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in odd}) if odd else df
    out.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(out.schema).parquet(path)
    return out.withColumns({c: F.lit(None) if kind == "void" else F.col(f"`{c}`").cast(kind) for c, kind in odd.items()}) if odd else out
