"""From shared signatures to components of similar sets, without writing out the pairs of a group.

A *candidate row* says that a set has a signature. Sets that share a signature may be similar; how surely similar
sets share one is up to the caller. Four steps find the components of the similarity graph over all such pairs:

1. slots of signatures are counted: sorted within tasks and sent as the bytes of their differences, three or so for a
   signature. A signature alone in its slot is of one set. Rows of other slots are written out; their signatures are
   counted exactly, with partial sums ahead of the shuffle, and only rows of those that several sets share go on;
2. each bucket of a signature contributes a star from the member that meets most others over all buckets; stars are
   verified exactly and joined;
3. buckets whose members are then all in one component are done, whatever their size: no further link can change it.
   In the others, members of different components are compared by bounds that never rule out a similar pair (sizes,
   parity sketches); what comes out is the members that have such a partner, not the pairs;
4. the sets of these members are sent to their buckets, compared exactly there, and each bucket gives a spanning forest
   of its links: fewer rows than it has members, whatever the links among them.

A bucket of many members is dealt to several cells: its members have seats, and two seats meet in one cell, so no task
holds more than two seats of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernels
from ledgerloom.llm.components import components
from ledgerloom.plans.runtime import drop, ship, stage

#: Rows up to which a table of ids is sent to every executor; a longer one is joined through a shuffle.
SMALL_ROWS = 1_000_000
#: Members, and features of members, that one seat of a bucket is meant for.
SEAT, SEAT_FEATURES = 4096, 1 << 20
_BLOCK = 1024
#: Bits of a signature's slot, and slots that a task sorts at a time.
_SLOT_BITS, _SLOTS = 40, 1 << 20
#: A bitmap has at most two to this many bits: 16 MB.
_MAP_BITS = 27
#: Members up to which buckets are compared many at once.
_SMALL = 64


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if a count proves it small; Spark's own choice otherwise."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL_ROWS else df


def small_lists(df: DataFrame, column: str, entries: int = SMALL_ROWS) -> DataFrame:
    """Marked for broadcast if its lists hold few entries in all."""
    total = df.select(F.sum(F.size(column))).first()[0] or 0
    return F.broadcast(df) if total <= entries else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores ahead as it takes to be no column of ``df``, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _tagged(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the place of their ``column`` in a bitmap, and the words of the bitmap of ``keys``, 16 MB at most."""
    bits = min(_MAP_BITS, max(12, int(8 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    word, bit = F.shiftright(slot, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_word", word).withColumn("_bit", bit), F.broadcast(words)


def likely(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be in ``keys``, by a bitmap of at most 16 MB that goes to every executor.

    It only spares rows the way through a join: where the bitmap is too small for the keys, it lets more through.
    """
    tagged, words = _tagged(rows, keys, column)
    return tagged.join(words, "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_bits")


def flagged(rows: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """All rows, with ``flag`` true for those that ``likely`` keeps: where it is false, ``column`` is surely not in ``keys``."""
    tagged, words = _tagged(rows, keys, column)
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    return tagged.join(words, "_word", "left").withColumn(flag, hit).drop("_word", "_bit", "_bits")


# --- slots: which signatures may be of several sets, for some bytes a signature


def packed(sorted_values: np.ndarray) -> bytes:
    """Ascending numbers below 2**56 as the bytes of their differences, all as wide as the largest one needs."""
    step = np.diff(sorted_values, prepend=sorted_values.dtype.type(0)).astype("<u8")
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)[1:].reshape(-1, blob[0])
    step = np.zeros((len(raw), 8), np.uint8)
    step[:, : blob[0]] = raw
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def _twice_at_most(values: np.ndarray) -> np.ndarray:
    """Sorted values, those that come more than twice only two times."""
    values = np.sort(values)
    return values[np.append(np.ones(min(2, len(values)), bool), values[2:] != values[:-2])]


def _pack(parts: int):
    """Batches of lists of keys to rows (part, packed slots of that range, counted from its start)."""
    edges = np.array([((k << _SLOT_BITS) + parts - 1) // parts for k in range(parts + 1)], np.uint64)

    def out(held):
        values = _twice_at_most(np.concatenate(held))
        at = np.searchsorted(values, edges)
        some = np.flatnonzero(at[1:] > at[:-1])
        blobs = [packed(values[at[k] : at[k + 1]] - edges[k]) for k in some.tolist()]
        return pa.record_batch([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "slots"])

    def run(batches):
        held, size = [], 0
        for x in batches:
            keys = x.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append(keys.view(np.uint64) >> np.uint64(64 - _SLOT_BITS))
            size += len(keys)
            if size >= _SLOTS:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _repeated(parts: int):
    """All rows (part, packed slots) of some parts to the slots that come more than once."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for x in batches:
            for part, blob in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                held.setdefault(part, []).append(blob)
        while held:
            part, blobs = held.popitem()
            values = np.sort(np.concatenate([unpacked(b) for b in blobs]))
            first = np.uint64(((part << _SLOT_BITS) + parts - 1) // parts)
            yield pa.record_batch([pa.array(kernels.signed(np.unique(values[1:][values[1:] == values[:-1]]) + first))], names=["slot"])

    return run


def shared_rows(candidates: DataFrame) -> DataFrame:
    """Rows (key, node, ...), staged, of the candidates (keys array<long>, node, ...) but for keys that come once only: all
    rows of the others, and a few more. Keys are hashes whose first bits are spread evenly.

    The plan of the candidates is run twice and must name the same sets each time. What is shuffled is packed slots, the
    first bits of the keys; their repeats go to all executors as the bitmap of ``likely``.
    """
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = candidates.select("keys").mapInArrow(_pack(parts), "part int, slots binary")
    repeats = stage(sent.repartitionById(parts, F.col("part")).mapInArrow(_repeated(parts), "slot long"), "slots")
    rows = candidates.select(F.explode("keys").alias("key"), *[c for c in candidates.columns if c != "keys"])
    rows = rows.withColumn("slot", F.shiftrightunsigned("key", 64 - _SLOT_BITS))
    rows = stage(likely(rows, repeats, "slot").drop("slot"), "candidates")
    drop(repeats)
    return rows


def may_be_similar(n: np.ndarray, m: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """False only where den * |A & B| >= num * |A | B| is impossible, given sizes and a lower bound of |A ^ B|."""
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (differ * (num + den) <= (den - num) * (n + m))


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(kernels.fold(x, size) ^ kernels.fold(y, size)).sum())


def _prune(num: int, den: int):
    def run(batches):
        for x in batches:
            n, m = (x.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            d = np.array([sketch_distance(a, b) for a, b in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)], np.int64)
            yield x.select([0, 1]).filter(pa.array(may_be_similar(n, m, d, num, den)))

    return run


Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def stored_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of sets that are stored as the bytes of their sorted 64-bit features."""
    body, starts, ends = kernels.string_buffers(column)
    at = np.concatenate([[0], np.cumsum((ends - starts) // 8)])
    return np.frombuffer(body[starts[0] : ends[-1]].tobytes() if len(starts) else b"", np.uint64), at


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return den * both >= num * (len(s) + len(t) - both)


def _verify(num: int, den: int, sets: Sets):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                x = batch.slice(at, _BLOCK)
                (v, i), (w, j) = sets(x.column(2)), sets(x.column(3))
                ok = [_linked(v[i[k] : i[k + 1]], w[j[k] : j[k + 1]], num, den) for k in range(x.num_rows)]
                yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _folded(sketches: pa.Array, size: int = 32) -> np.ndarray:
    """All sketches brought to ``size`` bytes, one row each."""
    body, starts, ends = kernels.string_buffers(sketches)
    out = np.zeros((len(starts), size), np.uint8)
    width = ends - starts
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        wide = body[starts[rows][:, None] + np.arange(w)]
        out[rows] = np.bitwise_xor.reduce(wide.reshape(len(rows), -1, size), axis=1)
    return out


# --- cells: (key, a, b) with the members of seats a and b of the bucket


def whole_cells(batches, keys: int) -> Iterator[pa.Table]:
    """Batches that are sorted by their first ``keys`` columns, as tables that cut no run of equal ones."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        if not x.num_rows:
            continue
        key = np.stack([x.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        last = int(change[-1]) if len(change) else 0
        fresh = bool(held) and [held[0].column(i)[0].as_py() for i in range(keys)] != key[0].tolist()
        if last or fresh:
            done = [*held, x.slice(0, last)] if last else held
            yield pa.Table.from_batches(done).combine_chunks()
            held = []
        held.append(x.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Cells:
    """The rows (key, a, b, seat, node, root, own, n, ...) of some whole cells, and the pairs of a cell that may be similar."""

    def __init__(self, table: pa.Table, sketches: pa.Array):
        key, a, b, seat, self.node, self.root, own, self.n = (table.column(i).to_numpy() for i in range(8))
        self.own, self.sketch = own.astype(bool), sketches
        self.seat = np.where(a == b, -1 - np.arange(len(a)), seat)  # in a cell of one seat all pairs count
        self.first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self.size = np.diff(np.append(self.first, len(key)))

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small_rows = np.flatnonzero(np.repeat(self.size <= _SMALL, self.size))
        if len(small_rows):
            yield from self._few(small_rows, num, den)
        for k in np.flatnonzero(self.size > _SMALL):
            yield from self._many(np.arange(self.first[k], self.first[k] + self.size[k]), num, den)

    def _meet(self, i, j):
        return (self.root[i] != self.root[j]) & (self.own[i] | self.own[j]) & (self.seat[i] != self.seat[j])

    def _few(self, rows, num, den):
        """Pairs of many small cells at once: by size, component and folded sketch, then by whole sketches."""
        folded = _folded(self.sketch.take(pa.array(rows)))
        size = self.size[self.size <= _SMALL]
        count = np.repeat(np.cumsum(size), size) - np.arange(len(rows)) - 1
        for low in range(0, len(rows), _BLOCK * 8):
            high = min(low + _BLOCK * 8, len(rows))
            a = np.repeat(np.arange(low, high), count[low:high])
            begin = np.cumsum(count[low:high]) - count[low:high]
            b = a + 1 + np.arange(len(a)) - np.repeat(begin, count[low:high])
            ok = self._meet(rows[a], rows[b])
            a, b = a[ok], b[ok]
            for at in range(0, len(a), _BLOCK * 16):
                x, y = a[at : at + _BLOCK * 16], b[at : at + _BLOCK * 16]
                differ = np.bitwise_count(folded[x] ^ folded[y]).sum(1, dtype=np.int64)
                i, j = rows[x], rows[y]
                ok = np.flatnonzero(may_be_similar(self.n[i], self.n[j], differ, num, den))
                i, j = i[ok], j[ok]
                whole = np.array([sketch_distance(self.sketch[p].as_py(), self.sketch[q].as_py()) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
                ok = may_be_similar(self.n[i], self.n[j], whole, num, den)
                if ok.any():
                    yield i[ok], j[ok]

    def _many(self, rows, num, den):
        """Pairs of one large cell, block against block, in order of size so that most blocks need no look."""
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        n = self.n[rows]
        raw = [np.frombuffer(self.sketch[k].as_py(), np.uint8) for k in rows.tolist()]
        for i in range(0, len(rows), _BLOCK):
            # sizes ascend: partners of this block end where sizes are too large
            until = int(np.searchsorted(n * num, n[min(i + _BLOCK, len(n)) - 1] * den, "right"))
            size = len(raw[i])
            mine = np.stack([kernels.fold(x, size) for x in raw[i : i + _BLOCK]])
            for j in range(i, until, _BLOCK):
                stop = min(j + _BLOCK, until)
                theirs = np.stack([kernels.fold(x, size) for x in raw[j:stop]])
                for k in range(len(mine)):
                    ok = self._meet(rows[i + k], rows[j:stop])
                    if j == i:
                        ok[: k + 1] = False
                    at = np.flatnonzero(ok)
                    d = np.bitwise_count(theirs[at] ^ mine[k]).sum(1, dtype=np.int64)
                    hit = rows[j + at[may_be_similar(n[j:stop][at], n[i + k], d, num, den)]]
                    if len(hit):
                        yield np.full(len(hit), rows[i + k]), hit


def _survivors(num: int, den: int):
    """Rows (key, a, b, seat, node, root, own, n, sketch), sorted by cell, to those that may be similar to one of another component."""

    def run(batches):
        for t in whole_cells(batches, 3):
            alive = np.zeros(len(t), bool)
            for i, j in Cells(t, t.column(8).chunk(0)).pairs(num, den):
                alive[i] = alive[j] = True
            if alive.any():
                yield from t.select(["key", "node", "root", "own", "n"]).filter(pa.array(alive)).to_batches()

    return run


def _forest(num: int, den: int, sets: Sets):
    """Rows (key, a, b, seat, node, root, own, n, feats), sorted by cell, to links that join their components."""

    def run(batches):
        for t in whole_cells(batches, 3):
            v, at = sets(t.column(8).chunk(0))
            cells = Cells(t, pa.array([kernels.parity_sketch(v[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
            parent: dict[int, int] = {}

            def find(x, parent=parent):
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            out = []
            for some, others in cells.pairs(num, den):
                for i, j in zip(some.tolist(), others.tolist(), strict=True):
                    r, s = find(int(cells.root[i])), find(int(cells.root[j]))
                    if r != s and _linked(v[at[i] : at[i + 1]], v[at[j] : at[j + 1]], num, den):
                        parent[max(r, s)] = min(r, s)
                        out.append(sorted((int(cells.node[i]), int(cells.node[j]))))
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, parts: DataFrame, sets: DataFrame, payload: str) -> DataFrame:
    """Rows at their cells, sorted by them: ``parts`` (key, parts) says how many seats a bucket has, ``sets`` (node, ...)
    brings the payload, which joins after the seats so that it is shuffled to the cells only."""
    seated = rows.join(parts, "key").withColumn("seat", F.pmod(F.xxhash64("node"), F.col("parts"))).join(sets, "node")
    met = seated.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", F.least("seat", "other").alias("a"), F.greatest("seat", "other").alias("b"), "seat", "node", "root", "own", "n", payload)
    return met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def link(
    rows: DataFrame,
    meta: DataFrame | None,
    fetch: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    sets: Sets = stored_sets,
) -> DataFrame:
    """Components of the graph that links sets of a common signature with den * |A & B| >= num * |A | B|.

    rows ``(key long, node long[, own boolean])`` are the ``shared_rows`` of the candidates, and are dropped here: own is
    false for a set that is in these buckets only to meet others that are there on their own account; two such guests need
    not be compared. Without that column none is a guest. Repeated rows are fine. meta ``(node long, n long, sketch binary)`` has one
    row for each node, or is None to be derived from the features of the nodes that share a signature; ``fetch(nodes)``
    gives ``(node long, feats)``, one row for each of the nodes asked for, which ``sets`` turns into their sorted
    distinct 64-bit features: the bytes of those, unless ``sets`` says otherwise.
    Returns ``(node, root)`` for nodes that have a link; root is the least node of the component.
    """
    ship(rows.sparkSession)
    guests = "own" in rows.columns
    own = F.max("own") if guests else F.lit(True)
    met = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("far"), F.count("*").alias("met"), *([own.alias("any")] if guests else []))
    keys = stage(met.where("low <> far and any" if guests else "low <> far").select("key", "met"), "keys")
    # an inner join: the optimizer would move a semi-join below the bitmap
    found = likely(rows, keys, "key").join(keys, "key")
    shared = stage(found.groupBy("key", "node").agg(F.max("met").alias("met"), *([own.alias("own")] if guests else [])).withColumn("own", F.col("own") if guests else own), "shared")
    drop(keys, rows)
    kept = None
    if meta is None:
        nodes = stage(shared.select("node").distinct(), "nodes")
        kept = stage(fetch(nodes), "feats")
        meta = stage(kept.mapInArrow(_describe(sets), "node long, n long, sketch binary"), "meta")
        drop(nodes)

    # the set that meets most others is likely what they are copies of, so it leads the buckets that it is in
    known = shared.groupBy("node").agg(F.sum("met").alias("all_met"))
    leaders = shared.select("key", "node").join(known, "node").groupBy("key").agg(F.max(F.struct("all_met", "node"))["node"].alias("leader"))
    stars = shared.select("key", "node").join(leaders, "key").where("node <> leader")
    stars = stars.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    pruned = stage(_pruned(stars, meta, num, den), "stars")
    first = _verified(pruned, fetch, num, den, sets, kept)
    roots = components(first)
    drop(pruned)

    placed = shared.join(roots, "node", "left").select("key", "node", "own", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / SEAT).cast("long").alias("parts"))
    split = stage(split.where("lo <> hi").select("key", "parts"), "open")
    alive = _dealt(likely(placed, split, "key"), split, meta, "sketch").mapInArrow(_survivors(num, den), "key long, node long, root long, own boolean, n long")
    alive = stage(alive.distinct(), "alive")
    seats = alive.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SEAT), F.ceil(F.sum("n") / SEAT_FEATURES)).cast("long").alias("parts"))
    nodes = stage(alive.select("node").distinct(), "wanted")
    feats = kept if kept is not None else stage(fetch(nodes), "feats")
    second = _dealt(alive, seats, feats, "feats").mapInArrow(_forest(num, den, sets), "a long, b long")
    second = stage(second.distinct(), "links")
    final = roots if second.isEmpty() else components(first.union(second))
    drop(shared, split, alive, nodes, feats, first, second, *([meta] if kept is not None else []), *([roots] if final is not roots else []))
    return final


def _pruned(pairs: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    one, two = meta.toDF("a", "n", "s"), meta.toDF("b", "m", "t")
    with_meta = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "s", "t")
    return with_meta.mapInArrow(_prune(num, den), "a long, b long")


def _describe(sets: Sets):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                x = batch.slice(at, _BLOCK)
                v, i = sets(x.column(1))
                sketches = [kernels.parity_sketch(v[a:b]) for a, b in zip(i[:-1], i[1:], strict=True)]
                yield pa.record_batch([x.column(0), pa.array(np.diff(i)), pa.array(sketches, pa.binary())], names=["node", "n", "sketch"])

    return run


def _verified(pairs: DataFrame, fetch, num: int, den: int, sets: Sets, feats: DataFrame | None = None) -> DataFrame:
    """The pairs that are similar by their sets; feats are the sets if they are at hand."""
    own = []
    if feats is None:
        nodes = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
        feats = stage(fetch(nodes), "feats")
        own = [nodes, feats]
    both = pairs.join(feats.toDF("a", "x"), "a").join(feats.toDF("b", "y"), "b").select("a", "b", "x", "y")
    found = stage(both.mapInArrow(_verify(num, den, sets), "a long, b long").distinct(), "links")
    drop(*own)
    return found
