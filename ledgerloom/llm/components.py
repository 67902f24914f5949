"""Connected components of an edge table, as distributed union-find by contraction.

Each round every vertex hangs itself below the neighbour (or itself) of least random priority and the edges are
rewritten to those parents, which shrinks the graph by a constant factor a round whatever its shape; chains too,
since priorities are drawn anew each time. When at most ``finish`` edges are left, a bound that does not depend on
the data, one task closes the rest with union-find. Nothing reaches the driver but edge counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.runtime import drop, ship, stage

#: Edges that one task may close; beyond it the contraction goes on over all executors.
FINISH = 200_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges, and the least vertex of the component of each."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _close(batches):
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
    if a:
        nodes, roots = union_find(np.concatenate(a), np.concatenate(b))
        yield pa.record_batch([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """``(a long, b long)`` to ``(node long, root long)``: one row per vertex of an edge, root its least reachable vertex.

    Self-loops, repeated edges and either direction are fine; edges with a null end are no edges. An empty edge table
    gives an empty result.
    """
    spark = edges.sparkSession
    ship(spark)
    edges = edges.where("a is not null and b is not null and a <> b")
    now = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels, k = [], 0
    while now.count() > finish:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("m"))
        up = stage(up.select(F.col("u").alias("node"), F.col("m.v").alias("parent")), "parents")
        levels.append(up)
        left = up.toDF("a", "pa")
        right = up.toDF("b", "pb")
        then = now.join(left, "a").join(right, "b").where("pa <> pb")
        then = stage(then.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        drop(now)
        now, k = then, k + 1
    roots = stage(now.coalesce(1).mapInArrow(_close, "node long, root long"), "roots")
    drop(now)
    if not levels:
        return roots
    for up in reversed(levels):
        above = roots.toDF("parent", "above")
        wider = stage(up.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("root")), "roots")
        drop(roots, up)
        roots = wider
    least = roots.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("least"))
    named = stage(roots.join(least, "root").select("node", F.col("least").alias("root")), "roots")
    drop(roots)
    return named
