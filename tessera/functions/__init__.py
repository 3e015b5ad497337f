"""Column functions: the nulls-first lexicographic order."""

from tessera.functions.order import columns_geq, columns_gt, columns_leq, columns_lt, lex_cmp, lex_key, nullable_cmp, sort_partitions

__all__ = ["columns_geq", "columns_gt", "columns_leq", "columns_lt", "lex_cmp", "lex_key", "nullable_cmp", "sort_partitions"]
