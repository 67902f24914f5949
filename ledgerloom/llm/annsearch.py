"""Approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample and is itself bounded, so it goes to every executor; all rows are indexed, each
in the leaf that it falls into. The more rows there are, the finer the tree is, as far as its sample can tell apart. Largest inner product becomes smallest distance by one more component that brings all
vectors to the norm of the longest. A query descends by a priority queue over the nodes not yet opened, nearest centre
first, and so lists leaves in the order in which it would visit them. How many of them are searched is calibrated: the
true neighbours of a bounded set of queries, found by comparison with all rows, tell how far down those lists they lie,
and visits are widened until the recall wanted is reached, all leaves if need be. At most half of the queries are in
that set. Beyond that a query goes on until its leaves hold as many rows as it asks for.

Leaves join on their own. Rows and queries of a leaf are each dealt into parts by a hash, and every part of the one meets
every part of the other in a task of bounded size; a task returns its best few of each query, and these are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.linkage import whole_cells
from ledgerloom.llm.vecjoin import matrix, valid
from ledgerloom.plans.runtime import drop, ship, stage

#: Vectors that the tree is fitted on, children of a node.
SAMPLE, BRANCH = 20_000, 8
#: Rows that a leaf is meant to have, and bounds of the sample vectors of a leaf that is not split further.
LEAF_ROWS, LEAF = 4096, (8, 160)
#: Queries whose true neighbours set the number of visits, and the recall that these must reach.
CALIBRATION, RECALL = 128, 0.97
#: Rows of a leaf, and queries of it, that one task searches.
TASK, ASKED = 8192, 4096
_BLOCK = 256


class Tree:
    """Nodes by number, the root is 0: centres, children, and for leaves their leaf number."""

    def __init__(self, centres: np.ndarray, children: list[list[int]], longest: float):
        self.centres, self.children, self.longest = centres, children, longest
        self.leaves = [k for k, c in enumerate(children) if not c]
        self.leaf_of = {k: i for i, k in enumerate(self.leaves)}

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to the longest norm of the sample; longer ones get 0."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector: down the nearest child."""
        lifted = self.lift(x)
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            still = []
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                below = self.children[node]
                if below:
                    c = self.centres[below]
                    at[rows] = np.array(below)[((c * c).sum(1) - 2 * lifted[rows] @ c.T).argmin(1)]
                    still.append(rows)
            moving = np.concatenate(still) if still else np.zeros(0, np.int64)
        return np.array([self.leaf_of[int(k)] for k in at], np.int64) if len(at) else at

    def visits(self, queries: np.ndarray, most: int, rows: np.ndarray, least: int) -> np.ndarray:
        """Leaves of each query, best bin first: ``most`` of them, and more until they hold ``least`` of the ``rows`` of
        the leaves. What a query has fewer than another is -1."""
        flat = np.column_stack([queries, np.zeros(len(queries))])  # a query has nothing to add to its inner products
        far = (self.centres * self.centres).sum(1) - 2 * flat @ self.centres.T
        found: list[list[int]] = []
        for d in far:
            queue, mine, held = [(0.0, 0)], [], 0
            while queue and (len(mine) < most or held < least):
                _, node = heapq.heappop(queue)
                while self.children[node]:  # down to the best leaf below; the others wait for their turn
                    below = self.children[node]
                    best = min(below, key=d.__getitem__)
                    for c in below:
                        if c != best:
                            heapq.heappush(queue, (d[c], c))
                    node = best
                mine.append(self.leaf_of[node])
                held += int(rows[mine[-1]])
            found.append(mine)
        out = np.full((len(queries), max(map(len, found), default=0)), -1, np.int64)
        for q, mine in enumerate(found):
            out[q, : len(mine)] = mine
        return out


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres, ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def fit_tree(sample: np.ndarray, leaf: int = LEAF[1], seed: int = 5) -> Tree:
    """Hierarchical k-means on the lifted sample. A node of at most ``leaf`` vectors, or whose vectors do not part, is a leaf."""
    rng = np.random.Generator(np.random.PCG64(seed))
    longest = float(np.sqrt((sample * sample).sum(1)).max(initial=0.0))
    x = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample * sample).sum(1), 0))])
    centres, children, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        c, near = _k_means(x[rows], BRANCH, rng)
        groups = [rows[near == k] for k in range(BRANCH)]
        if sum(len(g) > 0 for g in groups) < 2:
            continue
        for k, g in enumerate(groups):
            if len(g):
                children[node].append(len(centres))
                centres.append(c[k])
                children.append([])
                todo.append((len(centres) - 1, g))
    return Tree(np.array(centres), children, longest)


def _index(tree):
    """Rows (id, vector) with their leaf."""

    def run(batches):
        size = tree.value.centres.shape[1] - 1
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.place(matrix(batch.column(1), size))
                yield pa.record_batch([pa.array(leaf), batch.column(0), batch.column(1)], names=["leaf", "id", "vector"])

    return run


def _route(tree, most, rows, least):
    """Queries (id, vector) to a row for each leaf that they visit."""

    def run(batches):
        size = tree.value.centres.shape[1] - 1
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                some = batch.slice(at, _BLOCK)
                leaves = tree.value.visits(matrix(some.column(1), size), most, rows.value, least)
                which, place = np.nonzero(leaves >= 0)
                yield pa.record_batch([pa.array(leaves[which, place]), some.column(0).take(pa.array(which))], names=["leaf", "id"])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """For each row of ``scores`` the k best columns but the query itself, ties to the smaller id: row and column numbers."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    else:
        r, c = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep]


def _search_leaf(size: int, k: int):
    """Rows (leaf, part, asked, query?, id, vector) sorted by leaf and parts, to the k best of the rows for each query."""

    def run(batches):
        for t in whole_cells(batches, 3):
            key = np.stack([t.column(i).to_numpy() for i in range(3)], 1)
            asked, ids = t.column(3).to_numpy(zero_copy_only=False).astype(bool), t.column(4).to_numpy()
            x = matrix(t.column(5).chunk(0), size)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True):
                q = a + np.flatnonzero(asked[a:b])
                r = a + np.flatnonzero(~asked[a:b])
                for at in range(0, len(q) if len(r) else 0, _BLOCK):
                    some = q[at : at + _BLOCK]
                    scores = x[some] @ x[r].T
                    i, j = _best(scores, ids[r], ids[some], k)
                    yield pa.record_batch([pa.array(ids[some][i]), pa.array(ids[r][j]), pa.array(scores[i, j])], names=["query_id", "vec_id", "score"])

    return run


def _compare_all(queries, k: int):
    """Rows (id, vector) to the k best of each batch for a bounded set of queries: comparison with all rows, in blocks."""

    def run(batches):
        own, x = queries.value
        for batch in batches:
            for at in range(0, batch.num_rows, TASK):
                some = batch.slice(at, TASK)
                names, rows = some.column(0).to_numpy(zero_copy_only=False), matrix(some.column(1), x.shape[1])
                scores = x @ rows.T
                r, c = _best(scores, names, own, k)
                leaf = some.column(2).to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(own[r]), pa.array(names[c]), pa.array(scores[r, c]), pa.array(leaf[c])], names=["query_id", "vec_id", "score", "leaf"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(spark: SparkSession, tree, indexed: DataFrame, rows: np.ndarray, queries: DataFrame, k: int) -> int:
    """Leaf visits after which the calibration queries have found RECALL of their true neighbours."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(min(CALIBRATION, -(-queries.count() // 2))).collect()
    if not some:
        return 1
    own, x = np.array([r["id"] for r in some], np.int64), np.array([r["vector"] for r in some], np.float64)
    data = spark.sparkContext.broadcast((own, x))
    columns = "query_id long, vec_id long, score double, leaf long"
    truth = _top(indexed.select("id", "vector", "leaf").mapInArrow(_compare_all(data, k), columns), k).collect()
    if not truth:
        return 1
    visits = tree.value.visits(x, len(rows), rows, 0)
    rank = {int(q): {int(leaf): i for i, leaf in enumerate(row)} for q, row in zip(own, visits, strict=True)}
    depth = np.sort([rank[r["query_id"]][r["leaf"]] for r in truth])
    return int(depth[int(np.ceil(RECALL * len(depth))) - 1]) + 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows found with the largest inner product with each query, but itself.

    Scores are inner products of the original vectors in double precision; ties go to the smaller id. Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do null ids and vectors of another length
    than the most frequent one. Rows that repeat an id are candidates each, though never of their own id; queries that
    share an id are one query. The index is approximate: it searches as many leaves as its calibration asks for. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    rows = plain(vectors)
    asked = plain(queries).groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["size"]
    rows, asked = rows.where(F.size("vector") == size), asked.where(F.size("vector") == size)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector")
    sample = np.array([r[0] for r in sample.toLocalIterator()], np.float64).reshape(-1, size)
    fitted = fit_tree(sample, int(np.clip(len(sample) * LEAF_ROWS // sizes["count"], *LEAF)))
    tree = spark.sparkContext.broadcast(fitted)
    indexed = stage(rows.mapInArrow(_index(tree), "leaf long, id long, vector array<double>"), "index")
    held = np.zeros(len(fitted.leaves), np.int64)
    for leaf, n in indexed.groupBy("leaf").agg(F.count("*")).collect():  # at most SAMPLE leaves
        held[leaf] = n
    visits = calibrate(spark, tree, indexed, held, asked, k)

    counted = spark.sparkContext.broadcast(held)
    routed = stage(asked.mapInArrow(_route(tree, visits, counted, k + 1), "leaf long, id long"), "routed")
    # one row for each leaf: into how many parts its rows and its queries are dealt
    split = lambda df, most, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / most).cast("long").alias(name))
    parts = F.broadcast(stage(split(indexed, TASK, "parts").join(split(routed, ASKED, "askers"), "leaf"), "parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    seat = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n))
    asking = routed.join(asked, "id").join(parts, "leaf").withColumn("part", every("parts")).withColumn("asked", seat("askers"))
    seated = indexed.join(parts, "leaf").withColumn("part", seat("parts")).withColumn("asked", every("askers"))
    shape_of = lambda df, q: df.select("leaf", "part", "asked", F.lit(q).alias("query"), "id", "vector")
    met = shape_of(asking, True).union(shape_of(seated, False)).repartition("leaf", "part", "asked").sortWithinPartitions("leaf", "part", "asked")
    found = met.mapInArrow(_search_leaf(size, k), "query_id long, vec_id long, score double")
    result = stage(_top(found, k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop(indexed, routed)
    return result
