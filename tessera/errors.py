"""Exceptions of the library."""


class StatsUnknownError(ValueError):
    """Partition bounds or sizes are needed but not known."""


class AppendError(ValueError):
    """Rows can't be appended to the dataset at the given path."""


class DecodingError(ValueError):
    """A manifest holds a value that can't be read."""
