"""Exact Jaccard self-join of documents on word shingles, by PartEnum signatures.

Sizes are cut into bands within which similar sets can differ by a known number of shingles. For a band, the hashed
domain of shingles is cut into ``n1`` parts and each of these into ``n2``; a signature is the content of a set in
``n2 - k2`` of the ``n2`` pieces of one part. If two sets differ in at most ``k`` shingles, some part holds at most
``k2`` of the differences, so some choice of its pieces holds none and the sets share that signature: no similar pair
is missed. A set signs for its own band and for the next one, whose members may be similar to it.

Pieces in which a set has nothing would all share one signature. ``spare`` further parts make up for them: only a set
with more weak parts than that signs its empty pieces too, and two such sets still find each other there.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernels
from ledgerloom.llm.components import components
from ledgerloom.llm.linkage import link, shared_rows, small, unused
from ledgerloom.plans.runtime import drop, ship, stage

#: Stands for a null id inside the operator; such documents are one vertex below all others.
NO_ID = -(2**63)
#: Classes that a task remembers to sign only the first of equal sets.
_SEEN = 1 << 20
_ROWS = 1 << 16


@lru_cache(None)
def band_of(size: int, num: int, den: int) -> int:
    """Index of the size band. Bands are [l, l * den // num], back to back from 1."""
    low, i = 1, 0
    while size > low * den // num:
        low, i = low * den // num + 1, i + 1
    return i


@lru_cache(None)
def band_edges(i: int, num: int, den: int) -> tuple[int, int]:
    low = 1
    for _ in range(i):
        low = low * den // num + 1
    return low, low * den // num


#: Shingles that a signature covers on average before it is worth to have more signatures for more cover.
_COVER = 4.0


def _weak(n1: int, n2: int, k2: int, spare: int, least: int) -> tuple[float, float]:
    """Shingles that a signature covers in sets of size ``least``, and the share of these sets with more weak parts than
    spare ones, as a Poisson tail."""
    cover = least * (n2 - k2) / (n1 * n2)
    expected = n1 * min(1.0, math.comb(n2, k2) * math.exp(-cover))
    if expected > 500:  # a Poisson law is near normal there, and its terms vanish in doubles
        return cover, 0.5 * math.erfc((spare + 0.5 - expected) / math.sqrt(2 * expected))
    term = head = math.exp(-expected)
    for i in range(1, spare + 1):
        term *= expected / i
        head += term
    return cover, max(0.0, 1 - head)


@lru_cache(None)
def plan(tag: int, num: int, den: int) -> tuple[int, int, int, int, int]:
    """(differences k, parts n1, pieces n2, free pieces k2, spare parts) for joins whose larger set is in band ``tag``.

    All choices are exact; this is the cheapest in signatures, each shingle of cover that they lack counting double and
    each hundredth of weak sets as much as all others.
    """
    least = band_edges(max(tag - 1, 0), num, den)[0]
    k = (den - num) * 2 * band_edges(tag, num, den)[1] // (den + num)
    best = None
    for k2 in range(0, min(k, 4) + 1):
        for n2 in range(k2 + 1, k2 + 6) if k2 else (1,):
            parts, spare = k // (k2 + 1) + 1, 0
            while spare <= parts:
                cover, weak = _weak(parts + spare, n2, k2, spare, least)
                cost = (parts + spare) * math.comb(n2, k2) * 2 ** max(0.0, _COVER - cover) * (1 + 100 * weak)
                if best is None or cost < best[0]:
                    best = (cost, (k, parts + spare, n2, k2, spare))
                if weak < 1e-6:
                    break
                spare += 1 + spare // 8
    return best[1]


@lru_cache(None)
def _choices(n2: int, k2: int) -> list[tuple[int, ...]]:
    return list(combinations(range(n2), n2 - k2))


@lru_cache(None)
def _salts(tag: int, n1: int, ways: int) -> np.ndarray:
    x = np.arange(n1 * ways, dtype=np.uint64).reshape(n1, ways)
    return kernels.mix(x + np.uint64((tag + 1) << 40))


def signatures(values: np.ndarray, mixed: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Signatures of one set, those of its own band and those of the next: ``values`` its sorted distinct hashes,
    ``mixed`` a second hash of each."""
    out = []
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    own = band_of(len(values), num, den)
    for tag in (own, own + 1):
        k, n1, n2, k2, spare = plan(tag, num, den)
        if k == 0:
            out.append(np.zeros(0, np.uint64))
            continue  # only equal sets are similar, and those are one class already
        cells = n1 * n2
        edges = np.arange(cells + 1, dtype=np.uint64) * np.uint64((2**64 - 1) // cells)
        at = np.searchsorted(values, edges)
        at[-1] = len(values)
        sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2)
        counts = np.diff(at).reshape(n1, n2)
        choices = _choices(n2, k2)
        if n2 == 1:
            content, held = sums, counts
        else:
            content = np.stack([sums[:, list(c)].sum(1, dtype=np.uint64) for c in choices], 1)
            held = np.stack([counts[:, list(c)].sum(1) for c in choices], 1)
        keys = kernels.mix(content + _salts(tag, n1, len(choices)))
        empty = held == 0
        out.append(keys.ravel() if empty.any(1).sum() > spare else keys[~empty])
    return out


def _sets(batches, width):
    """(rows, values, offsets) of the shingle sets of the rows, whose last column is the text, block by block."""
    for batch in batches:
        body, starts, ends = kernels.string_buffers(batch.column(batch.num_columns - 1))
        for i, j in kernels.row_blocks(starts, ends):
            h, r = kernels.words(body, starts[i:j], ends[i:j])
            s, r = kernels.shingles(h, r, width, j - i)
            values, at = kernels.distinct_sorted(s, r, j - i)
            yield batch.slice(i, j - i), values, at


def _marked(batches, width):
    """(rows, values, second hashes, offsets, two hashes of each set) of the rows, block by block."""
    for ids, values, at in _sets(batches, width):
        mixed = kernels.mix(values + np.uint64(77))
        yield ids, values, mixed, at, kernels.segment_sums(kernels.mix(mixed), at), kernels.segment_sums(mixed, at)


def _profile(width):
    def run(batches):
        for rows, values, _, at, one, two in _marked(batches, width):
            sketches = [kernels.parity_sketch(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch(
                [rows.column(0), rows.column(1), pa.array(np.diff(at)), pa.array(kernels.signed(one)), pa.array(kernels.signed(two)), pa.array(sketches, pa.binary())],
                names=["doc", "mark", "n", "h1", "h2", "sketch"],
            )

    return run


def _sign(width, num, den):
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for _, values, mixed, at, one, two in _marked(batches, width):
            out, held = [], 0
            for i, mark in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                a, b = at[i], at[i + 1]
                if a == b or mark in seen:
                    continue
                if len(seen) < _SEEN:
                    seen.add(mark)
                for own, k in zip((True, False), signatures(values[a:b], mixed[a:b], num, den), strict=True):
                    out.append((k, one[i], two[i], own))
                    held += len(k)
                if held >= _ROWS:
                    yield _rows(out)
                    out, held = [], 0
            if held:
                yield _rows(out)

    return run


def _rows(out):
    keys, one, two, own = zip(*out, strict=True)
    offsets = np.cumsum([0, *(len(k) for k in keys)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kernels.signed(np.concatenate(keys))))
    return pa.record_batch([lists, *(pa.array(kernels.signed(np.array(x, np.uint64))) for x in (one, two)), pa.array(own)], names=["keys", "h1", "h2", "own"])


def _features(width):
    def run(batches):
        for _, values, _, at, one, two in _marked(batches, width):
            feats = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([pa.array(kernels.signed(one)), pa.array(kernels.signed(two)), pa.array(feats, pa.binary())], names=["h1", "h2", "feats"])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: ``(<id_col>, n_shingles long, component_id long)``.

    Rows link when ``den * |A & B| >= num * |A | B|`` for their sets of ``width``-word shingles (words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer words make one shingle of all). ``component_id`` is the least
    id reachable by links, the row's own included. Null, empty and blank texts have no shingles and link with nothing.
    Null ids count as one id below all others and come back as null. Repeated rows come back as often as they came in;
    rows with one id and several texts are one vertex, with the links of all its texts. Other columns are not read,
    whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), text.alias("text"))
    profile = stage(slim.mapInArrow(_profile(width), "doc long, mark long, n long, h1 long, h2 long, sketch binary"), "profile")
    # sets, not ids, are what is joined: a set is named by its first hash, and by both where two sets share that
    filled = profile.where("n > 0")
    twice = [r["h1"] for r in filled.groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi")).where("lo <> hi").select("h1").collect()]  # a few in 2**32 sets
    node = F.when(F.col("h1").isin(twice), F.xxhash64("h1", "h2")).otherwise(F.col("h1")) if twice else F.col("h1")
    sets = filled.select(node.alias("node"), "doc", "mark", "n", "sketch")
    classes = stage(sets.groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("place"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    signed = slim.select("doc", "mark", "text").mapInArrow(_sign(width, num, den), "keys array<long>, h1 long, h2 long, own boolean")
    candidates = signed.select("keys", node.alias("node"), "own")

    def fetch(nodes: DataFrame) -> DataFrame:
        places = nodes.join(classes, "node").select(F.col("place.doc").alias("doc"), F.col("place.mark").alias("mark")).distinct()
        found = slim.join(small(places), ["doc", "mark"], "left_semi").select("doc", "mark", "text").mapInArrow(_features(width), "h1 long, h2 long, feats binary")
        return found.select(node.alias("node"), "feats").dropDuplicates(["node"])

    roots = link(shared_rows(candidates), classes.select("node", "n", "sketch"), fetch, num, den)
    rooted = sets.select("node", "doc").join(roots, "node", "left").select("doc", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    # an id with texts in several components holds these together
    several = rooted.groupBy("doc").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    bridges = stage(rooted.join(several.select("doc", "a"), "doc").select("a", F.col("root").alias("b")).where("a <> b").distinct(), "bridges")
    whole = rooted
    if not bridges.isEmpty():
        over = components(bridges).toDF("root", "above")
        whole = rooted.join(over, "root", "left").select("doc", F.coalesce("above", "root").alias("root"))
    firsts = whole.groupBy("root").agg(F.min("doc").alias("first"))
    # one row for each id that has words: its component is that of any of its texts
    named = stage(whole.groupBy("doc").agg(F.min("root").alias("root")).join(firsts, "root").select("doc", "first"), "named")
    out = profile.select("doc", F.col("n").alias("n_shingles")).join(named, "doc", "left")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = out.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc")))
    result = stage(out.select(null("doc").alias(id_col), "n_shingles", null("component").alias("component_id")), "ngram_join")
    drop(profile, classes, roots, rooted, bridges, named)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are linked, over any number of links, to one of lesser id.

    Documents without words stay. Rows that share an id stay or go together. No name of a column of ``docs`` is in the way.
    """
    found = ngram_join(docs, id_col, text_col, **options)
    gone = found.where("n_shingles > 0").where(F.coalesce(F.col(id_col), F.lit(NO_ID)) != F.coalesce("component_id", F.lit(NO_ID)))
    (key,) = unused(docs, "_id")
    gone = stage(gone.select(F.col(id_col).alias(key)).distinct(), "gone")
    return docs.join(small(gone), docs[id_col].cast("long") == F.col(key), "left_anti")
