"""Integrity checks, each a query for its violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.windows import broken_links, with_previous
from ledgerloom.schema import MAX_COMMITMENTS, MAX_RANGES, RANGE_SIZE, SHIELDED

# fixed values: the named checks of a range, in the order in which they are made
RANGE_CHECKS = (
    "blob_length", "blob_digest", "range_version", "range_decode", "range_start", "range_length", "block_height", "block_link",
    "sapling_size", "orchard_size", "ironwood_size", "end_hash", "end_sapling_size", "end_orchard_size", "end_ironwood_size", "unshielded",
)


def first_failure(checked: DataFrame, checks: dict[str, Column], keys: Sequence[str] = ("start_height",), order: str = "height") -> DataFrame:
    """``(*keys, height, check)``: per key the first row in height order that fails, and the first check it fails."""
    name = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()])
    failed = checked.withColumn("check", name).where("check is not null")
    return failed.groupBy(*keys).agg(F.min_by(F.struct(F.col(order).alias("height"), "check"), order).alias("f")).select(*keys, "f.height", "f.check")


def range_violations(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """First failure of each range of ``blocks`` against its entry ``(start_height, end_hash, sapling, orchard, ironwood)``.

    Blocks carry ``add_<pool>`` and ``<pool>_size``; sizes must grow by what is added and end where the entry says.
    """
    rows = with_previous(blocks, ["hash", *[f"{p}_size" for p in SHIELDED]])
    rows = rows.withColumn("start_height", F.col("height") - F.pmod("height", F.lit(RANGE_SIZE)))
    rows = rows.join(entries.select("start_height", F.col("end_hash"), *[F.col(p).alias(f"end_{p}") for p in SHIELDED]), "start_height")
    ends = F.col("height") == F.col("start_height") + RANGE_SIZE - 1
    first = F.col("height") == 0
    checks = {"block_link": first | (F.col("previous_hash") == F.col("prev_hash"))}
    checks |= {f"{p}_size": F.col(f"{p}_size") == F.coalesce(F.col(f"previous_{p}_size"), F.lit(0)) + F.col(f"add_{p}") for p in SHIELDED}
    checks |= {"end_hash": ~ends | (F.col("hash") == F.col("end_hash"))}
    checks |= {f"end_{p}_size": ~ends | (F.col(f"{p}_size") == F.col(f"end_{p}")) for p in SHIELDED}
    return first_failure(rows, checks)


def index_violations(blocks: DataFrame, hash_index: DataFrame) -> DataFrame:
    """``(height, check)`` where blocks and the hash index do not name each other one to one."""
    both = blocks.select("height", "hash").join(hash_index.select(F.col("hash").alias("h"), F.col("height").alias("i")), F.col("hash") == F.col("h"), "full_outer")
    check = F.when(F.col("h").isNull(), "not indexed").when(F.col("hash").isNull(), "no block").when(F.col("height") != F.col("i"), "other height")
    return both.select(F.coalesce("height", "i").alias("height"), check.alias("check")).where("check is not null")


def duplicate_hashes(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """``(hash, n)``: hashes that would stand more than once after ``offered`` is added."""
    return stored.select("hash").union(offered.select("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


def startup(blocks: DataFrame, hash_index: DataFrame) -> DataFrame:
    """All violations that a start of the store looks for: ``(height, check)``."""
    counts = blocks.agg(F.min("height").alias("lo"), F.max("height").alias("hi"), F.count("*").alias("n")).where("n > 0 and (lo <> 0 or hi - lo + 1 <> n)")
    return broken_links(blocks).union(index_violations(blocks, hash_index)).union(counts.select(F.col("hi").alias("height"), F.lit("row count").alias("check")))


def manifest_violations(entries: DataFrame, sealed_through: int) -> DataFrame:
    """``(start_height, check)`` of manifest entries: places, lengths, sizes, active pools, epoch ends, coverage."""
    order = Window.orderBy("start_height")  # one row per thousand blocks, and a manifest is one document
    before = {f"before_{c}": F.lag(c).over(order) for c in ("start_height", "end_height", "epoch_end", *SHIELDED, *[f"{p}_frontier" for p in SHIELDED])}
    rows = entries.withColumns(before).withColumn("after", F.lead("start_height").over(order))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    falls = [F.col(p) < zero(f"before_{p}") for p in SHIELDED]
    quiet = [(F.coalesce(F.col(f"before_{p}_frontier"), F.lit("")) != "") & (F.col(f"{p}_frontier") == "") for p in SHIELDED]
    any_of = lambda parts: parts[0] | parts[1] | parts[2]
    check = (
        F.when(F.col("start_height") != F.coalesce(F.col("before_end_height") + 1, F.lit(0)), "start")
        .when(F.col("end_height") != F.col("start_height") + RANGE_SIZE - 1, "length")
        .when(any_of(falls), "sizes fall")
        .when(any_of(quiet), "pool ends")
        .when(F.col("after").isNull() & ~F.col("epoch_end"), "epoch end")
        .when(F.col("after").isNull() & (F.col("end_height") != sealed_through), "sealed through")
    )
    return rows.select("start_height", check.alias("check")).where("check is not null")


def sampled_heights(blocks: DataFrame, per_range: int, seed: str) -> DataFrame:
    """``(start_height, height)``: so many heights of each range, by the order of a seeded hash; reruns agree."""
    start = F.col("height") - F.pmod("height", F.lit(RANGE_SIZE))
    drawn = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col("height").cast("string")), 256)
    rows = blocks.select(start.alias("start_height"), "height", drawn.alias("_h"))
    place = F.row_number().over(Window.partitionBy("start_height").orderBy("_h"))
    return rows.withColumn("_k", place).where(F.col("_k") <= per_range).select("start_height", "height")


def root_mismatch(rebuilt: DataFrame, answered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First mismatch per pool of rebuilt roots against a node's: missing on either side or different."""
    both = rebuilt.select("pool", *keys, F.col("root").alias("a")).join(answered.select("pool", *keys, F.col("root").alias("b")), ["pool", *keys], "full_outer")
    wrong = both.where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "not rebuilt").when(F.col("b").isNull(), "not answered").otherwise("differs")
    return wrong.groupBy("pool").agg(F.min_by(F.struct(*keys, kind.alias("kind")), F.struct(*keys)).alias("f")).select("pool", "f.*")


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(side, ...)``: rows of one table that the other lacks, counting repeats; empty if they are equal."""
    return a.exceptAll(b).select(F.lit("only first").alias("side"), "*").union(b.exceptAll(a).select(F.lit("only second").alias("side"), "*"))


def root_rule(size: Column, root: Column, rebuilt: Column) -> Column:
    """A node may leave a root out only where the pool is empty."""
    return F.coalesce(root == rebuilt, size == 0)


def epoch_groups(entries: DataFrame, most_ranges: int = MAX_RANGES, most_commitments: int = MAX_COMMITMENTS) -> DataFrame:
    """``(start_height, group, ends, by_rule)``: ranges grouped into epochs by count and by commitments added."""
    from ledgerloom.operators.windows import greedy_groups

    order = Window.orderBy("start_height")
    total = F.col("sapling") + F.col("orchard") + F.col("ironwood")
    added = entries.select("start_height", (total - F.coalesce(F.lag(total).over(order), F.lit(0))).alias("added"))
    return greedy_groups(added, "start_height", "added", most_ranges, most_commitments)


def epoch_part_after(groups: DataFrame, height: int) -> DataFrame:
    """What is left of an epoch after ``height``, which must end a range: the rows of epoch_groups behind it in the epoch that
    goes on there. The whole next epoch if ``height`` ends one; no rows if no range ends there or none follows."""
    goes_on = groups.where(F.col("start_height") == height + 1).select("group")  # one row at most
    return groups.where(F.col("start_height") > height).join(F.broadcast(goes_on), "group", "left_semi")
