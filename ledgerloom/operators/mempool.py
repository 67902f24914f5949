"""Pending transactions, and exclusion of those that a caller knows by a suffix of their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def excluded(mempool: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``(txid)`` of pending transactions that a suffix names alone. ``suffixes (suffix)`` are hex, at most 64 digits.

    A suffix of several transactions excludes none; the empty one names all. The comparison is a join on the reversed
    text: suffixes of each length meet ids cut to that length, so no pair is tried that does not match.
    """
    asked = suffixes.select(F.lower("suffix").alias("suffix")).where(F.length("suffix") <= 64).distinct().withColumn("n", F.length("suffix"))
    lengths = asked.select("n").distinct()  # at most 65 rows
    cut = mempool.select(F.lower("txid").alias("txid")).distinct().crossJoin(F.broadcast(lengths))
    # a part of length 0 is empty, not the whole id
    ends = cut.withColumn("suffix", F.when(F.col("n") == 0, F.lit("")).otherwise(F.expr("right(txid, n)")))
    hits = ends.join(asked, ["suffix", "n"]).groupBy("suffix").agg(F.count("*").alias("hits"), F.min("txid").alias("txid"))
    return hits.where("hits = 1").select("txid").distinct()


def remaining(mempool: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Pending transactions without the excluded ones, in order of their ids."""
    return mempool.join(excluded(mempool, suffixes), "txid", "left_anti").orderBy("txid")


def retain(cache: DataFrame, listed: DataFrame) -> DataFrame:
    """Cached transactions that are still listed."""
    return cache.join(listed.select("txid"), "txid", "left_semi")
