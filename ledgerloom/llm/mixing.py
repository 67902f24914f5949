"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target in words. A document of weight ``w`` is meant to be taken ``c * w`` times, ``c`` such that its
source meets the target and nothing is taken more than ``MOST`` times. The whole part of that number is certain. The
rest, below 1, is an inclusion probability: the document draws a uniform number from its id and is ranked by the odds of
that number over the odds of its inclusion, and each source takes documents in rank order until its words are met.

The cut in a source's order is found without sorting the source: ranks fall into ``CELLS`` cells, the words of the
cells are summed ahead of the window, and only rows of the one cell that holds the cut are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.linkage import small, unused
from ledgerloom.plans.runtime import stage

#: No document is taken more often, and no target exceeds so many times its source.
MOST = 2
#: Cells of the rank of a source; a cell is the most that one task puts in order for it.
CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def draw(id_col: str, seed: str) -> Column:
    """A uniform number in (0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, source_col: str, weights: tuple[int, ...], share: float) -> DataFrame:
    """``(source, source_size, target)``: water-filling of ``share`` times all words over the sources by weight.

    Sources weigh as their rank by code point says, null last; one that reaches MOST times its size stops there and the
    excess goes to the others by weight. All sums are whole numbers, so the outcome does not depend on row order.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    per = per.withColumn("w", weight).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("cap") / F.col("w"), F.col(source_col).asc_nulls_last())
    ahead = first.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("all"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(ahead), none).alias("cap_before"),
        F.coalesce(F.sum("w").over(ahead), none).alias("w_before"),
    )
    per = per.withColumn("rate", (F.col("all") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    # in this order the capped sources come first, so the first one below its cap has the level of all after it; later rates are lower
    per = per.withColumn("level", F.max(F.when(F.col("cap") > F.col("rate") * F.col("w"), F.col("rate"))).over(everything))
    below = F.col("level").isNotNull() & (F.col("cap") > F.col("level") * F.col("w"))
    return per.select(source_col, "source_size", F.when(below, F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _saturated(sizes: DataFrame, goals: DataFrame, source_col: str, rounds: int = 30) -> DataFrame:
    """Copies wanted of each row for unequal weights: c * weight, at most MOST, c raised while rows reach that."""
    on = sizes[source_col].eqNullSafe(goals["_source"])
    rows = sizes.join(goals, on).drop("_source").withColumn("full", F.lit(False))
    own = Window.partitionBy(source_col)
    for _ in range(rounds):
        open_mass = F.sum(F.when(~F.col("full"), F.col("size") * F.col("weight")).otherwise(0.0)).over(own)
        fixed = F.sum(F.when(F.col("full"), F.col("size") * MOST).otherwise(0.0)).over(own)
        rows = rows.withColumn("c", F.when(open_mass > 0, F.greatest((F.col("target") - fixed) / open_mass, F.lit(0.0))).otherwise(0.0))
        rows = stage(rows.withColumn("now", F.col("c") * F.col("weight") >= MOST), "saturation")
        grew = rows.where("now and not full").limit(1).count()
        rows = rows.withColumn("full", F.col("full") | F.col("now")).drop("now")
        if not grew:
            break
    return rows.withColumn("copies", F.when(F.col("full"), float(MOST)).otherwise(F.col("c") * F.col("weight"))).drop("c", "full")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    weight_col: str | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ``(<id>, size, source_size, target, taken)``, all counts in words of the text.

    ``taken`` is size times the copies the mix takes, 0 to MOST. ``weight_col`` gives documents unequal chances within
    their source (a null or negative weight is 0); without it all are equal. Null text has size 0 and is never taken; a
    null source is a source of its own, last. Documents with one id draw one number, so repeated rows stand together in
    rank and are then told apart by size alone; a null id draws like an empty one. Reruns agree row by row. Other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    counted = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), counted.alias("size"), weight.alias("weight"))
    sizes = stage(slim, "sizes")
    goals = stage(targets(sizes, "src", weights, share), "targets").withColumnRenamed("src", "_source")
    if weight_col:
        rows = _saturated(sizes, goals, "src")
    else:
        rows = sizes.join(goals, sizes["src"].eqNullSafe(goals["_source"])).drop("_source")
        rows = rows.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor("copies").cast("long")
    rows = rows.withColumn("whole", whole).withColumn("chance", F.col("copies") - F.col("whole"))
    u = draw("id", seed)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    rows = rows.withColumn("rank", F.when((F.col("chance") > 0) & (F.col("size") > 0), odds))
    # odds / (1 + odds) is monotone and spreads over (0, 1); under equal chances the cells are near even
    rows = rows.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS).cast("int"))
    certain = F.sum(F.col("whole") * F.col("size"))
    wanted = rows.groupBy("src", "cell").agg(F.sum("size").alias("words"), certain.alias("certain"), F.first("target").alias("goal"))
    own = Window.partitionBy("src")
    wanted = wanted.withColumn("rest", F.col("goal") - F.sum("certain").over(own))
    upto = own.orderBy(F.col("cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    live = wanted.where("cell is not null").withColumn("ahead", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = live.where("ahead < rest").groupBy("src").agg(F.max("cell").alias("cut"), F.max_by("ahead", "cell").alias("ahead"), F.first("rest").alias("rest"))
    cut = stage(cut, "cut").withColumnRenamed("src", "_source")
    rows = rows.join(cut, rows["src"].eqNullSafe(cut["_source"]), "left").drop("_source")

    before = F.col("cell") < F.col("cut")
    at_cut = F.col("cell") == F.col("cut")
    plain = rows.where(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.when(F.coalesce(before, F.lit(False)), 1).otherwise(0))
    # rows of the cut cell: taken while that brings the words nearer to the rest
    run = Window.partitionBy("src").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(at_cut).withColumn("to", F.col("ahead") + F.sum("size").over(run))
    edge = edge.withColumn("extra", F.when(2 * F.col("to") - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)).drop("to")
    every = plain.unionByName(edge)
    taken = (F.col("whole") + F.col("extra")) * F.col("size")
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes it: each row as often as its document is taken, in the columns of ``docs``.

    Rows of one id stand or fall together: if several share it, each is repeated as often as the one taken most.
    """
    id_col = options.get("id_col", "doc_id")
    mixed = mix(docs, **options)
    key, times, copy = unused(docs, "_id", "_times", "_copy")
    taken = mixed.where("taken > 0").groupBy(F.col(id_col).alias(key)).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias(times))
    taken = stage(taken, "times")
    rows = docs.join(small(taken), docs[id_col].eqNullSafe(taken[key]))
    repeated = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)


#: The same for DuckDB, word for word: targets, ranks and cuts, without the cells.
SQL = """
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM s GROUP BY source
), q AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap FROM p
), r AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER f, 0.0::DOUBLE) AS cap_before, coalesce(sum(w) OVER f, 0.0::DOUBLE) AS w_before
  FROM q WINDOW f AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, (total - cap_before) / (all_w - w_before) AS rate FROM r
), l AS (
  SELECT *, max(CASE WHEN cap > rate * w THEN rate END) OVER () AS level FROM t
), g AS (
  SELECT source, source_size, CASE WHEN level IS NOT NULL AND cap > level * w THEN level * w ELSE cap END AS target FROM l
), d AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS copies,
         (CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), e AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS chance FROM d
), k AS (
  SELECT *, CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rnk,
         target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM e
), m AS (
  SELECT *, sum(CASE WHEN rnk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN rnk IS NOT NULL AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM m
"""
