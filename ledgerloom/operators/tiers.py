"""The three tiers of the log as one table: sealed ranges, mutable rows above them, the volatile head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import PERSIST_DEPTH, RANGE_SIZE, SEAL_DEPTH


def unite(sealed: DataFrame, mutable: DataFrame, volatile: DataFrame) -> DataFrame:
    """All visible rows with their ``tier``. Tiers are disjoint by height, so this is a plain union."""
    named = lambda df, t: df.withColumn("tier", F.lit(t))
    return named(sealed, "sealed").unionByName(named(mutable, "mutable")).unionByName(named(volatile, "volatile"))


def boundaries(tip: int) -> dict[str, int]:
    """Greatest height of each tier under a head ``tip`` (-1: none): durable is PERSIST_DEPTH deep, and the ranges that
    end SEAL_DEPTH deep or deeper are sealed."""
    durable = max(tip - PERSIST_DEPTH, -1)
    sealable = tip - SEAL_DEPTH
    sealed = (sealable + 1) // RANGE_SIZE * RANGE_SIZE - 1 if sealable >= 0 else -1
    return {"volatile": tip, "mutable": durable, "sealed": min(sealed, durable)}


def tier_of(height: Column, tip: int) -> Column:
    at = boundaries(tip)
    return F.when(height <= at["sealed"], "sealed").when(height <= at["mutable"], "mutable").when(height <= at["volatile"], "volatile")


def coverage(united: DataFrame) -> DataFrame:
    """One row per tier: rows, first and last height."""
    return united.groupBy("tier").agg(F.count("*").alias("n_blocks"), F.min("height").alias("first_height"), F.max("height").alias("last_height"))


def seal(mutable: DataFrame, seal_through: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose whole range is within ``seal_through``, rows that stay mutable)."""
    last = (seal_through + 1) // RANGE_SIZE * RANGE_SIZE - 1
    ranged = mutable if "range_id" in mutable.columns else mutable.withColumn("range_id", F.floor(F.col("height") / RANGE_SIZE).cast("bigint"))
    return ranged.where(F.col("height") <= last), mutable.drop("range_id").where(F.col("height") > last)


def missing_ranges(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Ranges ``(start_height, blob_len)`` to export: those without a file, or with one of another length."""
    have = present.select("start_height", F.col("blob_len").alias("_len"))
    joined = wanted.join(have, "start_height", "left")
    reason = F.when(F.col("_len").isNull(), "missing").when(F.col("_len") != F.col("blob_len"), "wrong length")
    return joined.select("start_height", reason.alias("reason")).where("reason is not null")


def byte_chunks(blobs: DataFrame, length: str, chunk: int, offset: int = 0) -> DataFrame:
    """``(..., chunk, at, size)``: the pieces in which a blob is sent from ``offset`` on."""
    left = F.greatest(F.col(length) - offset, F.lit(0))
    count = F.ceil(left / chunk).cast("bigint")
    rows = blobs.withColumn("chunk", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))))
    at = F.lit(offset) + F.col("chunk") * chunk
    return rows.withColumn("at", at).withColumn("size", F.least(F.lit(chunk), F.col(length) - at))


def frames(parts: DataFrame) -> DataFrame:
    """Messages from frames ``(message, place, kind, more, body)``: bodies in order up to the first frame without
    ``more``; a kind that changes, a missing place or no last frame is named in ``problem``. One message is one row, of
    4 MiB at most by the protocol."""
    gathered = parts.groupBy("message").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "more", "body"))).alias("f"))
    last = F.array_position(F.transform("f", lambda x: x["more"]), False)
    used = F.slice("f", 1, F.when(last > 0, last.cast("int")).otherwise(F.size("f")))
    rows = gathered.withColumn("last", last).withColumn("used", used)
    problem = (
        F.when(F.size(F.array_distinct(F.transform("used", lambda x: x["kind"]))) > 1, "kind changes")
        .when(~F.transform("used", lambda x: x["place"]).eqNullSafe(F.sequence(F.lit(0), F.size("used") - 1).cast("array<bigint>")), "frame missing")
        .when(F.col("last") == 0, "no last frame")
    )
    body = F.array_join(F.transform("used", lambda x: x["body"]), "")
    return rows.select("message", F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))
