"""Running values over the dense height order, without ever ordering the log in one task.

All of them work in two levels: inside a range of consecutive heights by a window, and over the ranges, of which there
are a thousandth as many, by what each range sums up to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.runtime import ship
from ledgerloom.schema import RANGE_SIZE, SUBTREE_LEAVES


def _group(order: str = "height", size: int = RANGE_SIZE) -> Column:
    return F.floor(F.col(order) / size)


def _until_now(part: Column | str, order: str):
    return Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _ahead(totals: DataFrame, columns: Sequence[str], by: str, size: int) -> DataFrame:
    """Sums of all groups before each group, by splitting the groups once more if there are many."""
    upper = totals.withColumn("_u", F.floor(F.col(by) / size))
    tops = upper.groupBy("_u").agg(*[F.sum(c).alias(c) for c in columns])
    over = Window.orderBy("_u").rowsBetween(Window.unboundedPreceding, -1)  # one row for a million heights
    tops = tops.select("_u", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_t_{c}") for c in columns])
    inner = Window.partitionBy("_u").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    within = upper.select("_u", by, *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_w_{c}") for c in columns])
    return within.join(tops, "_u").select(by, *[(F.col(f"_w_{c}") + F.col(f"_t_{c}")).alias(f"_a_{c}") for c in columns])


def running_sums(rows: DataFrame, columns: dict[str, str], order: str = "height", size: int = RANGE_SIZE, group: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """``rows`` with, for each ``source: target``, the sum of source over all rows up to this one.

    ``group`` names a column that holds a row's group, ``order // size``, already: rows that are dealt by it stay where
    they are. ``totals`` are rows ``(order, *sources)`` with the same sums by group, where these are cheaper to make.
    """
    ranked = rows.withColumn("_g", F.col(group) if group else _group(order, size))
    counted = ranked if totals is None else totals.withColumn("_g", _group(order, size))
    sums = counted.groupBy("_g").agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])
    ahead = _ahead(sums, list(columns), "_g", size)
    own = _until_now("_g", order)
    sums = {target: (F.coalesce(F.col(f"_a_{source}"), F.lit(0)) + F.sum(source).over(own)).cast("bigint") for source, target in columns.items()}
    return ranked.join(ahead, "_g", "left").withColumns(sums).drop("_g", *[f"_a_{c}" for c in columns])


def with_previous(rows: DataFrame, columns: Sequence[str], order: str = "height", size: int = RANGE_SIZE) -> DataFrame:
    """``rows`` with ``previous_<column>`` of the row one height below; null if there is none."""
    own = Window.partitionBy("_g").orderBy(order)
    ranked = rows.withColumn("_g", _group(order, size))
    inside = ranked.withColumns({"_at": F.lag(order).over(own)} | {f"previous_{c}": F.lag(c).over(own) for c in columns})
    edges = rows.where(F.pmod(F.col(order) + 1, F.lit(size)) == 0).select((F.col(order) + 1).alias(order), *[F.col(c).alias(f"_e_{c}") for c in columns])
    joined = inside.join(edges, order, "left")
    near = F.col("_at") == F.col(order) - 1
    first = F.pmod(F.col(order), F.lit(size)) == 0
    return joined.withColumns({f"previous_{c}": F.when(near, F.col(f"previous_{c}")).when(first, F.col(f"_e_{c}")) for c in columns}).drop("_g", "_at", *[f"_e_{c}" for c in columns])


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks that do not continue the one below: ``(height, check)``. The lowest block has nothing to continue."""
    lowest = blocks.agg(F.min("height").alias("_low"))
    rows = with_previous(blocks.select("height", "hash", "prev_hash"), ["hash"]).crossJoin(F.broadcast(lowest)).where("height > _low")
    check = F.when(F.col("previous_hash").isNull(), "height").when(F.col("previous_hash") != F.col("prev_hash"), "link")
    return rows.select("height", check.alias("check")).where("check is not null")


def falling_sizes(blocks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(height, pool)`` where a cumulative size is less than one block below."""
    rows = with_previous(blocks.select("height", *columns), columns)
    pairs = F.array(*[F.when(F.col(c) < F.col(f"previous_{c}"), F.lit(c)) for c in columns])
    return rows.select("height", F.explode(F.array_compact(pairs)).alias("pool"))


def contiguous_prefix(rows: DataFrame, start: int = 0, order: str = "height", step: int = 1) -> DataFrame:
    """Rows from ``start`` up to the first gap. The gap is the least missing successor: one aggregate, no ordering."""
    nexts = rows.where(F.col(order) >= start).select((F.col(order) + step).alias(order))
    starts = rows.sparkSession.createDataFrame([(start,)], f"{order} bigint")
    gap = nexts.union(starts).join(rows.select(order), order, "left_anti").agg(F.min(order).alias("_gap"))
    return rows.crossJoin(F.broadcast(gap)).where(F.col(order).between(F.lit(start), F.col("_gap") - 1)).drop("_gap")


def linked_prefix(known: DataFrame, offered: DataFrame) -> DataFrame:
    """Blocks offered from the least height on that chain onto each other without a break, and onto ``known (height, hash)``."""
    parents = known.select((F.col("height") + 1).alias("height"), F.col("hash").alias("parent")).union(offered.select((F.col("height") + 1), "hash"))
    wrong = offered.select("height", "prev_hash").join(parents, "height", "left").groupBy("height").agg(F.max(F.coalesce(F.col("parent") == F.col("prev_hash"), F.lit(False))).alias("ok"))
    first = wrong.where("not ok").agg(F.min("height").alias("_bad"))
    return offered.crossJoin(F.broadcast(first)).where("_bad is null or height < _bad").drop("_bad")


def common_ancestor(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(ancestor)``: the greatest height up to which two chains agree, null if they agree nowhere.

    Hashes chain, so everything above the first difference differs too and no search is needed.
    """
    both = old.select("height", F.col("hash").alias("a")).join(new.select("height", F.col("hash").alias("b")), "height", "full_outer")
    ends = both.agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("height"))).alias("bad"), F.max("height").alias("top"), F.min("height").alias("low"))
    found = F.coalesce(F.col("bad") - 1, F.col("top"))
    return ends.select(F.when(found >= F.col("low"), found).alias("ancestor"))


def replace_suffix(old: DataFrame, ancestor: DataFrame, replacement: DataFrame) -> DataFrame:
    """The old chain up to the ancestor, then the replacement; an empty one is a plain rollback."""
    kept = old.crossJoin(F.broadcast(ancestor)).where("height <= ancestor").drop("ancestor")
    new = replacement.crossJoin(F.broadcast(ancestor)).where("height > ancestor").drop("ancestor")
    return kept.unionByName(new)


def range_rollup(blocks: DataFrame, columns: Sequence[str], size: int = RANGE_SIZE) -> DataFrame:
    """One row per range: first and last height, rows, and the greatest of each cumulative column."""
    start = (F.col("height") - F.pmod("height", F.lit(size))).alias("start_height")
    return blocks.groupBy(start).agg(F.max("height").alias("end_height"), F.count("*").alias("n_blocks"), *[F.max(c).alias(c) for c in columns])


def subtree_spans(sizes: DataFrame, before: str, after: str, leaves: int = SUBTREE_LEAVES) -> DataFrame:
    """Rows with one ``subtree`` index for each subtree that is completed between two cumulative sizes."""
    low, high = F.floor(F.col(before) / leaves), F.floor(F.col(after) / leaves)
    spans = sizes.withColumn("subtree", F.explode(F.when(high > low, F.sequence(low, F.greatest(high - 1, low)))))
    return spans.withColumn("subtree", F.col("subtree").cast("bigint"))


def _fold(most_rows: int, most_weight: int, parts: bool):
    """Rows ([part], order, weight), sorted by that, to ([part], order, group, by_rule, ends), each row once the next one is known."""

    def run(batches):
        group = n = total = 0
        waiting = None  # the last row so far, with its part
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for part, o, w in zip(columns[0] if parts else [None] * batch.num_rows, *columns[-2:], strict=True):
                if waiting is not None:
                    same = waiting[0] == part
                    out.append((*waiting, waiting[3] or not same))
                    if not same:
                        group = n = total = 0
                n, total = n + 1, total + w
                full = n >= most_rows or total >= most_weight
                waiting = (part, o, group, full)
                if full:
                    group, n, total = group + 1, 0, 0
            if out:
                yield _folded(out, parts, batch.schema)
        if waiting is not None:
            yield _folded([(*waiting, True)], parts, batch.schema)

    return run


def _folded(out, parts, schema):
    import pyarrow as pa

    types = [schema.field(0).type, pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if parts else [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[1:], types[1:], strict=True)]
    names = ["order", "group", "by_rule", "ends"]
    return pa.record_batch(columns, names=["part", *names] if parts else names)


def greedy_groups(rows: DataFrame, order: str, weight: str, most_rows: int, most_weight: int, part: str | None = None) -> DataFrame:
    """``(order, group, ends, by_rule)``: consecutive rows grouped greedily; a group closes at ``most_rows`` rows or when
    its weights reach ``most_weight``. The last group ends the list, but by rule only if it was full.

    The fold is sequential by nature: each list passes through one task, sorted, a batch at a time, so that its length
    costs time but no memory. It runs over one row per range of a log (or per sample of a run), never over blocks;
    ``part`` splits independent lists, which are folded side by side.
    """
    ship(rows.sparkSession)
    long = lambda c, n: F.col(c).cast("bigint").alias(n)
    slim = rows.select(*([F.col(part).alias("part")] if part else []), long(order, "order"), long(weight, "weight"))
    dealt = slim.repartition("part").sortWithinPartitions("part", "order") if part else slim.repartition(1).sortWithinPartitions("order")
    shape = "order bigint, group bigint, by_rule boolean, ends boolean"
    if part:
        shape = f"part {slim.schema['part'].dataType.simpleString()}, {shape}"
    folded = dealt.mapInArrow(_fold(most_rows, most_weight, part is not None), shape)
    return folded.select(*([F.col("part").alias(part)] if part else []), F.col("order").alias(order), "group", "by_rule", "ends")
