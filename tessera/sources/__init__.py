"""Parquet sources and sinks with a manifest of partition statistics."""

from tessera.sources.parquet import scan_parquet, write_metadata

__all__ = ["scan_parquet", "write_metadata"]
