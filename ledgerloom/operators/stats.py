"""Statistics over measurements: percentiles, scenario summaries, per-band deltas, carried and next samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that one window orders when samples are looked up.
_RUN = 1_000


def nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles that are samples themselves: the one at rank ceil(n * p)."""
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(name) for name, p in points.items()], F.max(value).alias("max"))


def floor_index(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by another rule: the sample at place floor(n * p) from 0."""
    own = Window.partitionBy(*keys)
    ranked = rows.withColumn("_k", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count("*").over(own))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == F.floor(F.col("_n") * F.lit(p)), F.col(value))).alias(name) for name, p in points.items()])


def scenario_summary(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per scenario of samples ``(phase, status, blocks, complete_us, start_height, end_height)``.

    The status of a scenario is that of its worst part: a failed warm-up, a failed measurement, no sample, or ok; the
    rate is that of an ok scenario alone.
    """
    measured, good = F.col("phase") == "measure", (F.col("phase") == "measure") & (F.col("status") == "ok")
    counted = samples.groupBy(*keys).agg(
        F.count_if(measured).alias("attempts"),
        F.count_if(good).alias("successes"),
        F.count_if(measured & (F.col("status") != "ok")).alias("errors"),
        F.count_if((F.col("phase") == "warmup") & (F.col("status") != "ok")).alias("warmup_errors"),
        F.min(F.when(measured, F.least("start_height", "end_height"))).alias("min_height"),
        F.max(F.when(measured, F.greatest("start_height", "end_height"))).alias("max_height"),
        F.coalesce(F.sum(F.when(good, F.col("blocks"))), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum(F.when(good, F.col("complete_us"))), F.lit(0)).alias("busy_us"),
    )
    status = F.when(F.col("warmup_errors") > 0, "warmup_failed").when(F.col("errors") > 0, "failed").when(F.col("attempts") == 0, "no_samples").otherwise("ok")
    named = counted.withColumn("status", status)
    rate = F.when((F.col("status") == "ok") & (F.col("busy_us") > 0), F.col("blocks") * 1e6 / F.col("busy_us"))
    return named.withColumn("blocks_per_s", rate).drop("warmup_errors")


def first_per_band(samples: DataFrame, height: str, time: str, band: int) -> DataFrame:
    """The first sample of each band of heights, with the band; samples without a height say nothing."""
    known = samples.where(F.col(height).isNotNull() & ~F.isnan(F.col(height).cast("double")))
    banded = known.withColumn("band", F.floor(F.col(height) / band).cast("bigint"))
    rest = [c for c in banded.columns if c != "band"]
    best = banded.groupBy("band").agg(F.min_by(F.struct(*rest), F.struct(time, height)).alias("s"))
    return best.select("band", "s.*")


def band_deltas(marks: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """What changed from each mark to the next, and rates over the time between; spans without time are skipped.

    Marks are one row per band of a run, so their order is a small one.
    """
    order = Window.orderBy("band")
    deltas = {f"d_{c}": F.lead(c).over(order) - F.col(c) for c in columns}
    spans = marks.withColumns(deltas | {"seconds": F.lead(time).over(order) - F.col(time)}).where("seconds > 0")
    return spans.select("band", "seconds", *deltas, *[(F.col(f"d_{c}") / F.col("seconds")).alias(f"rate_{c}") for c in columns])


def carry_forward(samples: DataFrame, keys: Sequence[str], order: str, value: str, start: float = 0.0) -> DataFrame:
    """``value`` with gaps filled by the last one seen under the same key; ``start`` before the first."""
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(seen), F.lit(start)))


def next_sample(events: DataFrame, samples: DataFrame, time: str, value: str, bucket: int) -> DataFrame:
    """Each event with the first sample at or after it, or the last one of all (as-of forward, clamped).

    Times are whole numbers. Samples and events meet in buckets of ``bucket``; an event whose bucket holds no later
    sample takes the first one of the next bucket that has any, found over bucket heads alone.
    """
    heads = samples.withColumn("_b", F.floor(F.col(time) / bucket)).groupBy("_b").agg(F.min_by(F.struct(F.col(time), F.col(value)), F.struct(time, value)).alias("_head"))
    asked = events.withColumn("_b", F.floor(F.col(time) / bucket))
    wanted = asked.select("_b").distinct().withColumn("_q", F.lit(True)).unionByName(heads, allowMissingColumns=True)
    grouped = wanted.groupBy("_b").agg(F.max("_q").alias("_q"), F.first("_head", ignorenulls=True).alias("_head"))
    # the next head: inside a run of buckets by a window, else the first one of a later run, of which there are few
    grouped = grouped.withColumn("_r", F.floor(F.col("_b") / _RUN))
    after = Window.partitionBy("_r").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    beyond = Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)
    runs = grouped.groupBy("_r").agg(F.min_by("_head", F.when(F.col("_head").isNotNull(), F.col("_b"))).alias("_first"))
    runs = runs.select("_r", F.first("_first", ignorenulls=True).over(beyond).alias("_beyond"))
    later = grouped.withColumn("_near", F.first("_head", ignorenulls=True).over(after)).join(runs, "_r").select("_b", F.coalesce("_near", "_beyond").alias("_later"))
    last = samples.agg(F.max_by(F.struct(F.col(time), F.col(value)), F.struct(time, value)).alias("_last"))
    marked = asked.withColumn("_is", F.lit(0)).unionByName(
        samples.select(time, value).withColumn("_b", F.floor(F.col(time) / bucket)).withColumn("_is", F.lit(1)).withColumnRenamed(value, "_v"), allowMissingColumns=True
    )
    own = Window.partitionBy("_b").orderBy(time).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = F.min(F.when(F.col("_is") == 1, F.struct(F.col(time).alias("t"), F.col("_v").alias("v")))).over(own)
    joined = marked.withColumn("_near", near).where("_is = 0").join(later, "_b", "left").crossJoin(F.broadcast(last))
    pick = lambda a, b: F.coalesce(F.col(f"_near.{a}"), F.col(f"_later.{b}"), F.col(f"_last.{b}"))
    out = joined.withColumn("next_time", pick("t", time)).withColumn("next_value", pick("v", value))
    return out.select(*events.columns, "next_time", "next_value")


def pool_status(sizes: Column, computed: Column, answered: Column) -> Column:
    """What a node's root says about ours: absent, not computed, match, match by reversed bytes, or MISMATCH."""
    from ledgerloom.functions.scalars import display_order

    return (
        F.when(answered.isNull(), F.when(sizes == 0, "absent").otherwise("MISMATCH"))
        .when(computed.isNull(), "not-computed")
        .when(computed == answered, "match")
        .when(display_order(computed) == answered, "match-reversed")
        .otherwise("MISMATCH")
    )


def status_counts(rows: DataFrame, keys: Sequence[str], status: str, height: str) -> DataFrame:
    return rows.groupBy(*keys, status).agg(F.count("*").alias("n"), F.min(height).alias("first_height"))
