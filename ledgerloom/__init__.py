"""Analytics over append-mostly, hash-linked logs of nested records, on Spark SQL."""

__version__ = "0.1.0"
