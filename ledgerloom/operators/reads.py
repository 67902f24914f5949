"""Point lookups and ordered range scans over the united log.

``blocks`` is the whole visible log (see ``tiers.unite``); lookups are filters that reach the Parquet scan. Where a table
is laid out by ``range_id``, bounds on it are derived from the bounds on height, so that other ranges are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidArgument, NotFound, OutOfRange, Unavailable
from ledgerloom.schema import MAX_U32, RANGE_SIZE


def _within(blocks: DataFrame, low: int, high: int) -> DataFrame:
    rows = blocks.where(F.col("height").between(low, high))
    if "range_id" in blocks.columns:
        rows = rows.where(F.col("range_id").between(low // RANGE_SIZE, high // RANGE_SIZE))
    return rows


def by_height(blocks: DataFrame, height: int) -> DataFrame:
    return _within(blocks, height, height)


def by_hash(blocks: DataFrame, hash_hex: str) -> DataFrame:
    return blocks.where(F.col("hash") == hash_hex)


def by_hash_index(blocks: DataFrame, hash_index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks for the hashes of ``wanted (hash)``: hash to height by the index, height to block."""
    places = hash_index.join(wanted, "hash").select("hash", "height")
    return places.join(blocks.drop("hash"), "height")


def lookup(blocks: DataFrame, height: int | None = None, hash_hex: str = "") -> DataFrame:
    """One block by hash if one is given, else by height."""
    if hash_hex:
        if len(hash_hex) != 64:
            raise InvalidArgument("a block hash has 32 bytes")
        return by_hash(blocks, hash_hex)
    if height is None or not 0 <= height <= MAX_U32:
        raise InvalidArgument("a block is named by a hash or by a height of 32 bits")
    return by_height(blocks, height)


def volatile_first(volatile: DataFrame, durable: DataFrame, key: str) -> DataFrame:
    """Rows by ``key``: those of the volatile head, and of the durable log those that the head lacks."""
    return volatile.unionByName(durable.join(volatile.select(key), key, "left_anti"))


def tip(blocks: DataFrame) -> DataFrame:
    """``(height, hash)`` of the greatest height, as one row; no row for an empty log."""
    best = blocks.agg(F.max_by(F.struct("height", "hash"), "height").alias("t"))
    return best.where("t is not null").select("t.height", "t.hash")


def check_bounds(start: int | None, end: int | None, tip_height: int | None, ready: bool = True, fresh: bool = True, durable_tip: int | None = None) -> None:
    """The whole request is refused if an end is missing, not a height, or above the tip; a stale head refuses only what
    touches heights above the durable tip."""
    if start is None or end is None or not all(0 <= x <= MAX_U32 for x in (start, end)):
        raise InvalidArgument("a range needs two heights of 32 bits")
    if not ready or tip_height is None:
        raise Unavailable("the log is not ready")
    if max(start, end) > tip_height:
        raise OutOfRange(f"height {max(start, end)} is above {tip_height}")
    if not fresh and durable_tip is not None and max(start, end) > durable_tip:
        raise Unavailable("the head is stale")


def scan(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks from ``start`` to ``end``, both included, in that direction."""
    rows = _within(blocks, min(start, end), max(start, end))
    return rows.orderBy(F.col("height").asc() if end >= start else F.col("height").desc())


def numbered(rows: DataFrame, start: int, end: int) -> DataFrame:
    """A scan with its position ``pos`` from 0. Heights are dense, so the position needs no sort."""
    at = F.col("height") - start if end >= start else F.lit(start) - F.col("height")
    return rows.withColumn("pos", at.cast("bigint"))


def breaks(rows: DataFrame, ascending: bool = True) -> DataFrame:
    """Places of a scan where a block does not chain onto the one sent before it: ``(height, hash)``."""
    own = Window.partitionBy(F.floor(F.col("height") / RANGE_SIZE)).orderBy("height")
    inner = rows.select("height", "hash", "prev_hash", F.lag("hash").over(own).alias("before"), F.lag("height").over(own).alias("at"))
    broken = inner.where("at is not null and (before <> prev_hash or at <> height - 1)").select("height", "hash")
    # the first row of a range looks at the last one of the range before
    edge = inner.where("at is null").select("height", "hash", "prev_hash")
    last = rows.select((F.col("height") + 1).alias("height"), F.col("hash").alias("before")).where(F.col("height") % RANGE_SIZE == 0)
    first = rows.agg(F.min("height").alias("first"))
    crossed = edge.join(last, "height", "left").crossJoin(F.broadcast(first)).where("height <> first and (before is null or before <> prev_hash)")
    return broken.union(crossed.select("height", "hash"))


def one(found: DataFrame) -> DataFrame:
    """``found`` if it has a row, else an error. An action of at most one row."""
    if found.isEmpty():
        raise NotFound("no such block")
    return found


def next_activation(tip_row: DataFrame, activations: DataFrame) -> DataFrame:
    """The first activation above the tip: ``(height, name)`` joined to the tip; nulls if there is none."""
    later = activations.join(tip_row.select(F.col("height").alias("tip_height")), F.col("height") > F.col("tip_height"))
    best = later.agg(F.min_by(F.struct("height", "name"), "height").alias("n"))
    return tip_row.crossJoin(best).select(F.col("height").alias("tip_height"), F.col("n.height").alias("next_height"), F.col("n.name").alias("next_name"))


def clamp_range(requests: DataFrame, tip_height: int) -> DataFrame:
    """Requests ``(start, end)`` brought into the log: no start is 0, no end or 0 is the tip, swapped if reversed."""
    low = F.least(F.coalesce("start", F.lit(0)), F.lit(tip_height))
    high = F.least(F.when(F.coalesce("end", F.lit(0)) == 0, F.lit(tip_height)).otherwise(F.col("end")), F.lit(tip_height))
    return requests.withColumn("from_height", F.least(low, high).cast("bigint")).withColumn("to_height", F.greatest(low, high).cast("bigint"))
