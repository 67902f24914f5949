"""Projections of the nested transactions of a block by value pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidArgument
from ledgerloom.functions.scalars import saturate
from ledgerloom.schema import POOLS, SHIELDED

#: Arrays of a transaction that belong to each pool.
_ARRAYS = {"sapling": ("spends", "outputs"), "orchard": ("actions",), "ironwood": ("ironwood_actions",)}


def select_pools(pools: Sequence[str]) -> tuple[str, ...]:
    """An empty selection is the three shielded pools; unknown names are refused."""
    if unknown := [p for p in pools if p not in POOLS]:
        raise InvalidArgument(f"unknown pools: {', '.join(map(str, unknown))}")
    return tuple(dict.fromkeys(pools)) or SHIELDED


def has_payload(tx: Column) -> Column:
    """Does a transaction hold anything shielded?"""
    sizes = [F.size(tx[a]) for arrays in _ARRAYS.values() for a in arrays]
    out = sizes[0] > 0
    for s in sizes[1:]:
        out = out | (s > 0)
    return out


def drop_empty(blocks: DataFrame) -> DataFrame:
    """Blocks with their shielded transactions only."""
    return blocks.withColumn("vtx", F.filter("vtx", has_payload))


def by_pool(blocks: DataFrame, pools: Sequence[str]) -> DataFrame:
    """Arrays of other pools cleared, then transactions with nothing left dropped. Cumulative sizes stay."""
    chosen = select_pools(pools)
    if set(SHIELDED) <= set(chosen):
        return drop_empty(blocks)

    def clear(tx: Column) -> Column:
        for pool, arrays in _ARRAYS.items():
            if pool not in chosen:
                for a in arrays:
                    tx = tx.withField(a, F.filter(tx[a], lambda _: F.lit(False)))
        return tx

    return blocks.withColumn("vtx", F.filter(F.transform("vtx", clear), has_payload))


def nullifiers(blocks: DataFrame) -> DataFrame:
    """Spends, and of actions the nullifier alone; outputs cleared, sizes 0. Every transaction stays, even an empty one."""

    def keep(tx: Column) -> Column:
        bare = lambda a: F.struct(a["nullifier"].alias("nullifier"), F.lit("").alias("cmx"))
        tx = tx.withField("outputs", F.filter(tx["outputs"], lambda _: F.lit(False)))
        return tx.withField("actions", F.transform(tx["actions"], bare)).withField("ironwood_actions", F.transform(tx["ironwood_actions"], bare))

    sizes = {f"{p}_size": F.lit(0).cast("bigint") for p in SHIELDED if f"{p}_size" in blocks.columns}
    return blocks.withColumns({"vtx": F.transform("vtx", keep)} | sizes)


def additions(vtx: Column) -> dict[str, Column]:
    """Commitments that the transactions of a block add to each pool, saturated at 32 bits."""
    count = lambda array: saturate(F.aggregate(vtx, F.lit(0).cast("bigint"), lambda n, tx: n + F.size(tx[array])))
    return {"sapling": count("outputs"), "orchard": count("actions"), "ironwood": count("ironwood_actions")}


def encoded_size_bound(vtx: Column) -> Column:
    """Bytes that the encoded block cannot exceed."""
    # fixed values: bytes of a block, transaction, spend, output and action
    per_tx = lambda n, tx: (
        n + 64 + 36 * F.size(tx["spends"]) + 128 * F.size(tx["outputs"]) + 160 * (F.size(tx["actions"]) + F.size(tx["ironwood_actions"]))
    )
    return F.lit(192) + F.aggregate(vtx, F.lit(0).cast("bigint"), per_tx)


def add_transparent(shielded: DataFrame, transparent: DataFrame) -> DataFrame:
    """Transactions with their transparent side: a full outer merge by (height, index).

    ``transparent (height, index, vin, vout)``: those with neither inputs nor outputs add nothing, and null outpoints,
    which stand for newly made value, are no inputs.
    """
    real = transparent.withColumn("vin", F.filter("vin", lambda i: i["prevout_txid"].isNotNull()))
    real = real.where((F.size("vin") > 0) | (F.size("vout") > 0))
    return shielded.join(real, ["height", "index"], "full_outer")


def compact_mempool(mempool: DataFrame, pools: Sequence[str]) -> DataFrame:
    """Pending transactions ``(txid, tx)`` by pool, at index 0; those with nothing selected are dropped."""
    as_blocks = mempool.withColumn("vtx", F.array(F.col("tx").withField("index", F.lit(0).cast("bigint"))))
    kept = by_pool(as_blocks, pools).where(F.size("vtx") > 0)
    return kept.withColumn("tx", F.get("vtx", F.lit(0))).drop("vtx")
