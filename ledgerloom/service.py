"""The requests of a light client over one view of the log, each as a lazy DataFrame.

A view holds frozen tables: blocks of the durable log and of the head, transparent outputs and spends, mined and pending
transactions, and what a node tells (tree states, subtree roots, activations). Requests that need the tip fail while
the head is stale; block requests fail while a deep recovery runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidArgument, NotFound, Unavailable
from ledgerloom.operators import address, mempool, project, reads


@dataclass
class View:
    durable: DataFrame
    volatile: DataFrame
    durable_tip: int
    tip: int | None
    outputs: DataFrame | None = None
    spends: DataFrame | None = None
    mined: DataFrame | None = None
    transparent: DataFrame | None = None
    pending: DataFrame | None = None
    tree_states: DataFrame | None = None
    subtree_roots: DataFrame | None = None
    activations: DataFrame | None = None
    ready: bool = True
    fresh: bool = True
    info: dict = field(default_factory=dict)


class LightClientService:
    def __init__(self, view: View):
        self.view = view

    # --- blocks

    def _blocks(self) -> DataFrame:
        if not self.view.ready:
            raise Unavailable("the log is being recovered")
        return reads.volatile_first(self.view.volatile, self.view.durable, "height")

    def _fresh(self) -> None:
        if not self.view.fresh or self.view.tip is None:
            raise Unavailable("the head is not fresh")

    def latest_block(self) -> DataFrame:
        self._fresh()
        return reads.tip(self._blocks())

    def block(self, height: int | None = None, hash_hex: str = "") -> DataFrame:
        return project.drop_empty(reads.lookup(self._blocks(), height, hash_hex))

    def block_nullifiers(self, height: int | None = None, hash_hex: str = "") -> DataFrame:
        return project.nullifiers(self.block(height, hash_hex))

    def block_range(self, start: int | None, end: int | None, pools: Sequence[str] = ()) -> DataFrame:
        v = self.view
        chosen = project.select_pools(pools)
        reads.check_bounds(start, end, v.tip, v.ready, v.fresh, v.durable_tip)
        found = project.by_pool(reads.scan(self._blocks(), start, end), chosen)
        return self._transparent(found) if "transparent" in chosen else found

    def block_range_nullifiers(self, start: int | None, end: int | None) -> DataFrame:
        v = self.view
        reads.check_bounds(start, end, v.tip, v.ready, v.fresh, v.durable_tip)
        return project.nullifiers(project.drop_empty(reads.scan(self._blocks(), start, end)))

    def _transparent(self, blocks: DataFrame) -> DataFrame:
        """Blocks with ``transparent``, their transactions that have inputs or outputs in the clear, by index."""
        if self.view.transparent is None:
            raise Unavailable("no transparent data")
        empty = self.view.transparent.limit(0).select("height", "index")
        merged = project.add_transparent(empty, self.view.transparent)
        lists = merged.groupBy("height").agg(F.array_sort(F.collect_list(F.struct("index", "vin", "vout"))).alias("transparent"))
        return blocks.join(lists, "height", "left")

    # --- transactions and addresses

    def transaction(self, txid: str) -> DataFrame:
        if len(txid) != 64:
            raise InvalidArgument("a transaction is named by an id of 32 bytes")
        v = self.view
        wanted = v.mined.sparkSession.createDataFrame([(txid,)], "txid string")
        return address.find_transaction(v.mined, v.pending, wanted)

    def address_transactions(self, addresses: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
        v = self.view
        asked = v.outputs.sparkSession.createDataFrame([(start, end)], "start bigint, end bigint")
        low, high = reads.clamp_range(asked, v.tip or 0).select("from_height", "to_height").first()
        own = v.outputs.where(F.col("address").isin(address.listed(addresses))).where(F.col("height").between(low, high))
        return address.transactions(own.select("txid", "height", "tx_index").distinct(), v.mined)

    address_txids = address_transactions

    def address_balance(self, addresses: list[str]) -> DataFrame:
        rows = [(a,) for a in address.listed(addresses)]
        return self.address_balance_stream(self.view.outputs.sparkSession.createDataFrame(rows, "address string"))

    def address_balance_stream(self, addresses: DataFrame) -> DataFrame:
        unspent = address.unspent(self.view.outputs, self.view.spends)
        return address.balance(unspent, address.limited(addresses))

    def address_utxos(self, addresses: list[str], start_height: int = 0, max_entries: int = 0) -> DataFrame:
        rows = [(a,) for a in address.listed(addresses)]
        asked = self.view.outputs.sparkSession.createDataFrame(rows, "address string")
        return address.utxos(address.unspent(self.view.outputs, self.view.spends), asked, start_height, max_entries)

    # --- pending

    def mempool_tx(self, suffixes: list[str] = (), pools: Sequence[str] = ()) -> DataFrame:
        pending = self.view.pending
        asked = pending.sparkSession.createDataFrame([(s,) for s in suffixes], "suffix string")
        left = pending.join(mempool.excluded(pending, asked), "txid", "left_anti") if suffixes else pending
        return project.compact_mempool(left, pools).orderBy("txid")

    def mempool_stream(self) -> DataFrame:
        self._fresh()
        return self.view.pending.dropDuplicates(["txid"])

    # --- what the node knows

    def tree_state(self, height: int | None = None, hash_hex: str = "") -> DataFrame:
        """Block and tree state; an inactive pool has an empty tree."""
        block = reads.lookup(self._blocks(), height, hash_hex).select("height", "hash", "time")
        states = self.view.tree_states
        trees = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in states.columns if c.endswith("_tree")]
        return block.join(states.drop("height", "time"), "hash").select("height", "hash", "time", *trees)

    def latest_tree_state(self) -> DataFrame:
        self._fresh()
        return self.tree_state(self.view.tip)

    def subtree_roots(self, pool: str, start_index: int = 0, max_entries: int = 0) -> DataFrame:
        """Roots from an index on, at most so many (0: all), each with the hash of the block that completed it."""
        if pool not in ("sapling", "orchard", "ironwood"):
            raise InvalidArgument(f"no such pool: {pool}")
        if not all(0 <= x <= 65_535 for x in (start_index, max_entries)):
            raise InvalidArgument("subtree numbers have 16 bits")
        roots = self.view.subtree_roots.where((F.col("pool") == pool) & (F.col("subtree") >= start_index))
        ends = self._blocks().select(F.col("height").alias("end_height"), F.col("hash").alias("end_hash"))
        found = roots.join(ends, "end_height").orderBy("subtree")
        return found.limit(max_entries) if max_entries else found

    def lightd_info(self) -> DataFrame:
        found = reads.next_activation(self.latest_block(), self.view.activations)
        return found.withColumns({k: F.lit(v) for k, v in self.view.info.items()})

    def send_transaction(self, data: bytes) -> None:
        raise Unavailable("this library reads a log; it has no node to hand a transaction to")

    def ping(self) -> None:
        raise Unavailable("ping is off")


def mined_answer(answers: DataFrame) -> DataFrame:
    """Node answers ``(asked, txid, height)`` that say mined: a height of -1 is a side chain, none is pending; an answer for
    another id is an error."""
    same = F.when(F.col("txid") == F.col("asked"), F.col("txid")).otherwise(F.raise_error(F.lit("the node answered for another transaction")))
    return answers.where("height is not null and height >= 0").withColumn("txid", same)


def subtree_answer(answers: DataFrame, pool: str, start_index: int) -> DataFrame:
    """Node answers ``(pool, start_index, subtrees array<struct<root, end_height>>)`` to rows with an index by position."""
    wrong = (F.col("pool") != pool) | (F.col("start_index") != start_index)
    checked = answers.withColumn("subtrees", F.when(wrong, F.raise_error(F.lit("the node answered for other subtrees")).cast(answers.schema["subtrees"].dataType)).otherwise(F.col("subtrees")))
    rows = checked.select("pool", F.posexplode("subtrees").alias("k", "s"))
    index = F.lit(start_index) + F.col("k")
    bounded = F.when(index <= 65_535, index).otherwise(F.raise_error(F.lit("subtree index beyond 16 bits")).cast("int"))
    return rows.select("pool", bounded.cast("bigint").alias("subtree"), F.col("s.root").alias("root"), F.col("s.end_height").alias("end_height"))


def require(found: DataFrame, what: str) -> DataFrame:
    """``found`` if it has a row; an action of at most one row."""
    if found.isEmpty():
        raise NotFound(what)
    return found
