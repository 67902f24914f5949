"""Following a growing log: micro-batches into the store, pending transactions once each, late data by depth.

State that a reorganisation could take back never enters a streaming aggregate: the volatile head is recomputed from
each batch, and only what is PERSIST_DEPTH below the tip is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.tiers import tier_of
from ledgerloom.operators.windows import common_ancestor
from ledgerloom.schema import PERSIST_DEPTH
from ledgerloom.sources.store import Snapshot, Store


def reconcile(store: Store, base: Snapshot, head: DataFrame, tip: int) -> Snapshot:
    """Bring the durable log to ``tip - PERSIST_DEPTH`` of a polled head that reaches at least that far down.

    The head extends the log, replaces its mutable suffix, or, where it differs below the sealed height, the sealed
    ranges from the common ancestor on.
    """
    stable = head.where(F.col("height") <= tip - PERSIST_DEPTH)
    if base.generation == 0 or base.tip < 0:
        return store.append(base, stable)
    overlap = base.blocks().join(stable.select("height"), "height", "left_semi")
    ancestor = common_ancestor(overlap, stable.where(F.col("height") <= base.tip)).first()["ancestor"]
    if ancestor is None:
        low = stable.agg(F.min("height")).first()[0]
        ancestor = base.tip if low is None or low > base.tip else low - 1
    fresh = stable.where(F.col("height") > ancestor)
    if ancestor >= base.tip:
        return store.append(base, fresh)
    if ancestor >= base.state["sealed_through"]:
        return store.replace_suffix(base, ancestor, fresh)
    return store.replace_deep(base, ancestor, fresh)


def follow(heads: DataFrame, store: Store, checkpoint: str, once: bool = True):
    """A streaming query that reconciles the store with each micro-batch of polled blocks."""

    def apply(batch: DataFrame, _: int) -> None:
        tip = batch.agg(F.max("height")).first()[0]
        if tip is not None:
            reconcile(store, store.snapshot(), batch.dropDuplicates(["height"]), tip)

    return _start(heads, apply, checkpoint, once)


def pending_once(mempool: DataFrame, key: str = "txid") -> DataFrame:
    """Each pending transaction once, however often it is listed."""
    return mempool.dropDuplicates([key])


def late_rows(rows: DataFrame, tip: int) -> DataFrame:
    """What may happen to a row that arrives now, by its depth: volatile and mutable rows are applied, rows of a sealed
    range need a deep recovery."""
    tier = tier_of(F.col("height"), tip)
    action = F.when(tier == "sealed", "deep recovery").when(tier == "mutable", "replace").when(tier == "volatile", "head").otherwise("ahead")
    return rows.withColumn("action", action)


def health(snapshots: DataFrame) -> DataFrame:
    """SERVING while the head is ready and fresh."""
    return snapshots.withColumn("status", F.when(F.col("ready") & F.col("fresh"), "SERVING").otherwise("NOT_SERVING"))


def fill_range_meta(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Metadata rows, unverified, for sealed ranges that have none yet."""
    return entries.join(known.select("start_height"), "start_height", "left_anti").withColumn("state", F.lit("unverified"))


def _start(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool):
    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")
    return writer.start()
