"""Commitment trees, with SHA-256 in place of the chain's own hash functions: roots of subtrees, level by level.

A level is one aggregate over pairs, keyed by the pair's place, so a tree of any size is built without gathering it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY = "0" * 64


def subtree_roots(leaves: DataFrame, height: int) -> DataFrame:
    """``(subtree, root)`` of the full subtrees of ``2 ** height`` leaves ``(position, leaf hex)``, positions dense from 0."""
    level = leaves.select("position", F.col("leaf").alias("node"))
    for _ in range(height):
        pairs = level.groupBy(F.shiftright("position", 1).alias("position")).agg(
            F.max(F.when(F.col("position") % 2 == 0, F.col("node"))).alias("left"), F.max(F.when(F.col("position") % 2 == 1, F.col("node"))).alias("right")
        )
        level = pairs.where("left is not null and right is not null").select("position", F.sha2(F.concat("left", "right"), 256).alias("node"))
    return level.select(F.col("position").alias("subtree"), F.col("node").alias("root"))


def frontier_root(leaves: DataFrame, height: int) -> DataFrame:
    """``(root)`` of the whole tree, absent leaves being empty: missing right halves take the empty root of their level."""
    import hashlib

    level, empty = leaves.select("position", F.col("leaf").alias("node")), EMPTY
    for _ in range(height):
        half = lambda side: F.coalesce(F.max(F.when(F.col("position") % 2 == side, F.col("node"))), F.lit(empty))  # noqa: B023, E731
        pairs = level.groupBy(F.shiftright("position", 1).alias("position")).agg(half(0).alias("left"), half(1).alias("right"))
        level = pairs.select("position", F.sha2(F.concat("left", "right"), 256).alias("node"))
        empty = hashlib.sha256((empty + empty).encode()).hexdigest()
    return level.agg(F.coalesce(F.max("node"), F.lit(empty)).alias("root"))
