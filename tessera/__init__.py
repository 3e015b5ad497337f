"""Partition-aware datasets and training-data operators on PySpark."""

from tessera.errors import AppendError, DecodingError, StatsUnknownError
from tessera.operators.dataset import Dataset, concat, from_dataframe
from tessera.sources import scan_parquet, write_metadata

__all__ = ["AppendError", "Dataset", "DecodingError", "StatsUnknownError", "concat", "from_dataframe", "scan_parquet", "write_metadata"]
