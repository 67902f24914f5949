"""Exact range join of embeddings by angle: pivots cut the space, the triangle inequality replicates what is near a cut.

Vectors of one label are brought to unit length; cosine >= t is then a distance of at most r = sqrt(2 - 2t). A bounded
sample of each label gives pivots, in proportion to the label's size. A vector belongs to the cell of its nearest pivot
p. A partner within r that belongs to the cell of q lies beyond the plane between p and q, so the vector can have one
there only if its own distance to that plane is at most r: it is then sent to the cell of q too, as a guest. Every link
thus meets in the cell of each of its ends, and cells join on their own: residents are compared with all that are in
the cell, in blocks of products in double precision. The residents of a cell are dealt into parts and all that are in it
into chunks; each part meets each chunk in a task of bounded size.

A cell gives, for each vector in it, how many residents it links with, and a spanning forest of the links, not the
links: the counts of a vector over cells add up because every partner is resident once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components, union_find
from ledgerloom.llm.linkage import whole_cells
from ledgerloom.plans.runtime import drop, ship, stage

COSINE = 0.98
#: Residents that a cell is meant to have; residents, and others, that one task compares at most on average.
CELL, TASK, OTHERS = 2048, 2048, 8192
#: Vectors of a label from which pivots are drawn, at most, and pivots of all labels together, which every executor holds.
#: Beyond that cells grow, and their parts and chunks with them.
SAMPLE, PIVOTS = 16_384, 65_536
_BLOCK = 512
#: Slack of the geometric bounds against rounding; bounds only ever let more through.
_SLACK = 1e-9


def valid(column) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.float64).reshape(-1, size)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _assign(pivots, cosine):
    """Rows (label, size, node, vector) to their cell and, as guests, to the cells that may hold partners."""

    def run(batches):
        table = pivots.value
        reach = np.sqrt(2 - 2 * cosine)
        for batch in batches:
            label, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.lexsort((size, label))
            groups = np.flatnonzero(np.append(True, (np.diff(label[order]) != 0) | (np.diff(size[order]) != 0)))
            for a, b in zip(groups, np.append(groups[1:], len(order)), strict=True):
                rows = pa.array(order[a:b])
                part = batch.take(rows)
                key = (int(label[order[a]]), int(size[order[a]]))
                if key not in table:
                    yield _placed(part, np.zeros(b - a, np.int64), np.ones(b - a, bool))
                    continue
                p = table[key]
                step = max(16, min(_BLOCK * 4, (1 << 20) // len(p)))
                for at in range(0, b - a, step):
                    some = part.slice(at, step)
                    near = unit(matrix(some.column(3), key[1])) @ p.T
                    home = near.argmax(1)
                    best = near[np.arange(len(home)), home]
                    apart = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 0))
                    member = best[:, None] - near <= reach * apart + _SLACK
                    member[np.arange(len(home)), home] = True
                    which, cell = np.nonzero(member)
                    yield _placed(some.take(pa.array(which)), cell, cell == home[which])

    return run


def _placed(rows, cell, resident):
    return pa.record_batch([rows.column(0), rows.column(1), pa.array(cell), rows.column(2), pa.array(resident), rows.column(3)], names=["label", "size", "cell", "node", "resident", "vector"])


def _join_cell(cosine):
    """Rows (label, size, cell, part, chunk, node, host, other, weight, vector), sorted by that, to link counts and forest edges.

    Hosts are the residents of the part, others what is in the chunk; links are counted for others, over hosts.
    """

    def of_cell(t):
        node, host, other, weight = (t.column(i).to_numpy(zero_copy_only=False) for i in range(5, 9))
        x = unit(matrix(t.column(9).chunk(0), t.column(1)[0].as_py()))
        names, at = np.unique(node, return_inverse=True)
        hosts, others = np.flatnonzero(host), np.flatnonzero(other)
        count = np.zeros(len(names), np.int64)
        root = np.arange(len(names))
        for low in range(0, len(hosts), _BLOCK):
            some = hosts[low : low + _BLOCK]
            for start in range(0, len(others), _BLOCK * 8):
                them = others[start : start + _BLOCK * 8]
                i, j = np.nonzero(x[them] @ x[some].T >= cosine)
                i, j, heavy = at[them[i]], at[some[j]], weight[some[j]]
                off = i != j
                i, j = i[off], j[off]
                np.add.at(count, i, heavy[off])
                fresh = root[i] != root[j]  # others join what is one component already
                if fresh.any():
                    old, new = union_find(root[i[fresh]], root[j[fresh]])
                    moved = np.arange(len(names))
                    moved[old] = new
                    root = moved[root]
        keep = np.flatnonzero((count > 0) | (root != np.arange(len(names))))
        if len(keep):
            yield pa.record_batch([pa.array(names[keep]), pa.array(count[keep]), pa.array(names[root[keep]])], names=["node", "links", "root"])

    def run(batches):
        for t in whole_cells(batches, 5):
            key = np.stack([t.column(i).to_numpy() for i in range(5)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True):
                yield from of_cell(t.slice(a, b - a))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``(vec_id, n_links, component_id, kept)``.

    Vectors of equal, non-null label and equal length link at a cosine of at least ``cosine`` in double precision. Null
    and empty vectors, zero vectors and those with null or non-finite components link with nothing, nor do those with a
    null label. ``n_links`` counts other rows, equal vectors included; ``component_id`` is the least vec_id reachable.
    Repeated rows and rows that share an id are vectors of their own. Null ids are one id below all others and come
    back as null. Other columns are not read; an empty table gives no rows.
    """
    from ledgerloom.llm.ngramjoin import NO_ID

    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    usable = rows.where(valid(F.col("vector")) & F.col("label").isNotNull())
    # equal vectors are one node that counts as many, named by a hash, by two where different vectors share that
    one, two = F.xxhash64("label", "vector"), F.xxhash64("vector", "label", F.lit(1))
    doubled = usable.groupBy(one.alias("one")).agg(F.min(two).alias("lo"), F.max(two).alias("hi")).where("lo <> hi")
    twice = [r["one"] for r in doubled.select("one").collect()]  # a few in 2**32 vectors
    print_ = F.when(one.isin(twice), F.xxhash64(one, two)).otherwise(one) if twice else one
    grouped = usable.groupBy(print_.alias("node"), "label").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("weight"))
    classes = stage(grouped.select("label", F.size("vector").cast("long").alias("size"), "vector", "weight", "least", "node"), "classes")
    groups = classes.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    # smaller groups are one cell; of the others a few hash classes are enough to draw from, a bounded number of rows
    wanted = groups.select("label", "size", "n", F.least(F.ceil(F.col("n") / CELL), F.lit(SAMPLE)).cast("long").alias("k"))
    several = wanted.agg(F.sum("k")).first()[0] or 0
    wanted = wanted.withColumn("k", F.ceil(F.col("k") * min(1.0, PIVOTS / max(1, several))).cast("long"))
    wanted = wanted.where("k > 1")
    drawn = classes.join(wanted, ["label", "size"]).where(F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n") / (4 * F.col("k"))))) == 0)
    place = F.row_number().over(Window.partitionBy("label", "size").orderBy(F.xxhash64("node"), "node"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= F.col("k")).select("label", "size", "vector")
    chosen: dict[tuple[int, int], list] = {}
    for label, size, vector in drawn.toLocalIterator():  # at most twice PIVOTS, as each label has two at least
        chosen.setdefault((label, size), []).append(vector)
    shared = spark.sparkContext.broadcast({key: unit(np.array(v, np.float64)) for key, v in chosen.items()})
    placed = classes.select("label", "size", "node", "vector").mapInArrow(_assign(shared, cosine), "label long, size long, cell long, node long, resident boolean, vector array<double>")
    placed = stage(placed, "cells")
    cell = ["label", "size", "cell"]
    counts = placed.groupBy(*cell).agg(F.count_if("resident").alias("n"), F.count("*").alias("all"))
    counts = counts.select(*cell, F.greatest(F.lit(1), F.ceil(F.col("n") / TASK)).cast("long").alias("parts"), F.ceil(F.col("all") / OTHERS).cast("long").alias("chunks"))
    seat = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(c))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    dealt = placed.join(counts, cell).join(classes.select("node", "weight"), "node").withColumn("seat", seat("parts", 3)).withColumn("own", seat("chunks", 4))
    # everything is in one chunk, which all parts meet; a resident is a host in its part, which all chunks meet
    others = dealt.withColumn("part", F.explode(upto("parts"))).select(*cell, "part", F.col("own").alias("chunk"), "node", (F.col("resident") & (F.col("part") == F.col("seat"))).alias("host"), F.lit(True).alias("other"), "weight", "vector")
    more = dealt.where("resident and chunks > 1").withColumn("chunk", F.explode(F.array_except(upto("chunks"), F.array("own"))))
    hosts = more.select(*cell, F.col("seat").alias("part"), "chunk", "node", F.lit(True).alias("host"), F.lit(False).alias("other"), "weight", "vector")
    keys = [*cell, "part", "chunk"]
    met = others.unionByName(hosts).repartition(*keys).sortWithinPartitions(*keys)
    found = stage(met.mapInArrow(_join_cell(cosine), "node long, links long, root long"), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # from nodes to rows: every row knows its node by the hash of its vector
    grouped = classes.select("node", "least", "weight").join(roots, "node", "left").join(links, "node", "left")
    grouped = grouped.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min("least").alias("first"))
    named = stage(grouped.join(first, "root").select("node", "n_links", "first"), "named")
    keyed = rows.select("id", F.when(valid(F.col("vector")) & F.col("label").isNotNull(), print_).alias("node"))
    out = keyed.join(named, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", "id").alias("component"))
    again = stage(out, "rows")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    result = again.select(null("id").alias(id_col), "n_links", null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    drop(classes, placed, found, roots, named)
    return result


SQL = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), n AS (
  SELECT a, CAST(count(*) AS BIGINT) AS n_links FROM pairs GROUP BY a
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, reach.component_id, e.vec_id = reach.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN reach ON reach.a = e.vec_id
"""
