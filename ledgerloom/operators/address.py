"""Balances, unspent outputs and history of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidArgument, ResourceExhausted
from ledgerloom.schema import MAX_DISTINCT_ADDRESSES, MAX_LISTED_ADDRESSES


def listed(addresses: list[str], limit: int = MAX_LISTED_ADDRESSES) -> list[str]:
    """Distinct addresses in order; the limit counts the list as given."""
    if len(addresses) > limit:
        raise InvalidArgument(f"{len(addresses)} addresses are listed, {limit} are allowed")
    return list(dict.fromkeys(addresses))


def limited(addresses: DataFrame, limit: int = MAX_DISTINCT_ADDRESSES) -> DataFrame:
    """Distinct addresses of a table; the limit counts these."""
    distinct = addresses.select("address").distinct()
    if distinct.limit(limit + 1).count() > limit:
        raise ResourceExhausted(f"more than {limit} distinct addresses")
    return distinct


def unspent(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """Outputs ``(txid, out_index, ...)`` that no spend ``(prevout_txid, prevout_index)`` names."""
    return outputs.join(spends, (F.col("txid") == F.col("prevout_txid")) & (F.col("out_index") == F.col("prevout_index")), "left_anti")


def balance(unspent_outputs: DataFrame, addresses: DataFrame) -> DataFrame:
    """``(balance)`` of the distinct addresses together. A sum beyond 64 bits is an error."""
    own = unspent_outputs.join(addresses.select("address").distinct(), "address", "left_semi")
    return own.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("balance"))


def balances(unspent_outputs: DataFrame, addresses: DataFrame) -> DataFrame:
    """``(address, balance)``, 0 for an address without outputs."""
    sums = unspent_outputs.groupBy("address").agg(F.sum("value").alias("balance"))
    return addresses.select("address").distinct().join(sums, "address", "left").fillna(0, ["balance"])


def utxos(unspent_outputs: DataFrame, addresses: DataFrame, start_height: int, max_entries: int) -> DataFrame:
    """Unspent outputs from a height on, the first ``max_entries`` in chain order (0: all)."""
    own = unspent_outputs.join(addresses.select("address").distinct(), "address", "left_semi").where(F.col("height") >= start_height)
    ordered = own.orderBy("height", "tx_index", "out_index")
    return ordered.limit(max_entries) if max_entries else ordered


def transactions(history: DataFrame, mined: DataFrame) -> DataFrame:
    """The mined transactions that a history ``(height, tx_index, txid)`` names, in chain order; a missing one is an error."""
    rows = history.join(mined.select("txid", F.lit(True).alias("_here")), "txid", "left")
    present = F.when(F.col("_here"), F.col("txid")).otherwise(F.raise_error(F.concat(F.lit("a listed transaction is missing: "), "txid")))
    return rows.withColumn("txid", present).drop("_here").orderBy("height", "tx_index")


def find_transaction(mined: DataFrame, pending: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(txid, height)`` of the transactions wanted: mined first, else pending at height 0, else no row."""
    asked = wanted.select("txid").distinct()
    found = mined.join(asked, "txid", "left_semi").select("txid", "height")
    waiting = pending.join(asked, "txid", "left_semi").select("txid").distinct().join(found, "txid", "left_anti")
    return found.union(waiting.select("txid", F.lit(0).cast("bigint")))
