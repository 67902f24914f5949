"""Fuzzy line deduplication across a corpus: MinHash signatures, banding, exact Jaccard, union-find.

A line is what ``\\n`` separates. It is compared in a normal form: A-Z in lower case, white space runs as one space,
none at the ends. Equal normal forms are one class from the start. Of each class one line is signed: its shingles of
``CHARS`` characters are dealt to ``BANDS * ROWS`` bins by one hash, the least hash of each bin is kept, and empty bins
borrow from others in an order that is the same for all lines. Lines that agree in a whole band are candidates; exact
Jaccard over the shingle sets decides, and components of the links keep their first line (least doc_id, then line).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernels
from ledgerloom.llm.linkage import flagged, likely, link, shared_rows, small_lists, unused
from ledgerloom.llm.ngramjoin import NO_ID
from ledgerloom.plans.runtime import drop, ship, stage

#: Characters of a shingle. Eight keep unrelated lines of one language far below the threshold.
CHARS = 8
BANDS, ROWS = 12, 4
#: Similarity as a fraction, 0.8.
NUM, DEN = 4, 5
_SEEN = 1 << 20
_U = np.uint64
_NONE = _U(2**64 - 1)
_ORDERS = np.random.Generator(np.random.PCG64(7)).integers(0, BANDS * ROWS, (64, BANDS * ROWS))
_BAND_SALT = kernels.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


_EMPTY = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))


def lines(body: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Non-blank lines of a block of rows.

    Returns row, line number, two hashes of the normal form, its shingles as (values, line index) in line order and
    unsorted, and the first and one-past-last byte of each line in ``body``.
    """
    lo, hi = int(starts[0]), int(ends[-1])
    part = body[lo:hi]
    at = np.flatnonzero((part & 0xC0) != 0x80)
    n = len(at)
    if not n:
        return _EMPTY
    plain = n == len(part)
    lead = part if plain else part[at]
    letter = kernels.BYTE_WORD[kernels.LOWER[lead]]
    if not plain:
        wide = np.flatnonzero(lead >= 0xC0)
        chained = np.ones(len(wide), bool)
        padded = np.append(part, np.zeros(4, np.uint8))
        code = np.zeros(len(wide), np.uint64)
        for t in (1, 2, 3):
            follow = padded[at[wide] + t]
            chained &= (follow & 0xC0) == 0x80
            code |= np.where(chained, follow, 0).astype(np.uint64) << _U(8 * t)
        letter[wide] = kernels.mix(letter[wide] + code)
    space, feed = kernels.IS_SPACE[lead], lead == 0x0A
    feed_at = np.flatnonzero(feed)
    row_first = np.searchsorted(at, starts[ends > starts] - lo)
    line_at = np.unique(np.concatenate([[0], feed_at + 1, row_first]))
    line_at = line_at[line_at < n]
    # of a run of spaces inside a line the last one stays
    keep = ~space
    bridge = np.flatnonzero(space[:-1] & keep[1:])
    opening = np.zeros(n + 1, bool)
    opening[line_at] = True
    bridge = bridge[~opening[bridge + 1]]
    odd = opening[bridge] | space[np.maximum(bridge, 1) - 1]
    begun = ~odd
    if odd.any():
        solid = np.flatnonzero(keep)
        before = np.searchsorted(solid, bridge[odd]) - 1
        own = line_at[np.searchsorted(line_at, bridge[odd], "right") - 1]
        begun[odd] = (before >= 0) & (solid[np.maximum(before, 0)] >= own)
    bridge = bridge[begun]
    keep[bridge] = True
    letter[bridge] = kernels.BYTE_WORD[0x20]
    size = np.add.reduceat(keep.view(np.int8), line_at, dtype=np.int64)
    kept = np.flatnonzero(size)
    if not len(kept):
        return _EMPTY
    row = np.searchsorted(starts, at[line_at] + lo, "right") - 1
    number = np.searchsorted(feed_at, line_at) - np.searchsorted(feed_at, np.searchsorted(at, starts - lo))[row]
    bounds = np.append(at[line_at], len(part)) + lo
    first_byte, past = bounds[:-1][kept], bounds[1:][kept]

    letters, size = letter[keep], size[kept]
    last = np.cumsum(size)
    first = last - size
    power, inverse = kernels._powers(len(letters) + 1)
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * power[: len(letters)], out=total[1:])
    h1 = kernels.mix((total[last] - total[first]) * inverse[first] + size.astype(np.uint64))
    h2 = kernels.mix(np.add.reduceat(letters, first) + size.astype(np.uint64))

    x, reach = letters, 1
    while reach < CHARS:
        x = x[:-reach] * kernels._ODD[reach] + x[reach:] if len(x) > reach else x[:0]
        reach *= 2
    # a line of fewer characters than a shingle gives its whole form
    count = np.maximum(size - CHARS + 1, 1)
    of = np.repeat(np.arange(len(kept)), count)
    short = np.flatnonzero(size < CHARS)
    if len(short):
        x = np.append(x, np.zeros(CHARS, np.uint64))[: len(letters)]
        x[first[short]] = h1[short]
    whole = np.ones(len(letters), bool)
    tail = last[:, None] - 1 - np.arange(CHARS - 1)
    whole[tail[tail > first[:, None]]] = False
    values = x[whole[: len(x)]]
    values = values ^ (values >> _U(32))
    values *= _U(0xD6E8FEB86659FD93)
    values ^= values >> _U(29)
    return row[kept], number[kept], h1, h2, values, of, first_byte, past


def band_keys(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Band keys (n, BANDS) of n lines."""
    bins = BANDS * ROWS
    least = np.full(n * bins, _NONE)
    where = of * bins + (((values >> _U(32)) * _U(bins)) >> _U(32)).astype(np.int64)
    np.minimum.at(least, where, values * kernels._ODD[51])
    least = least.reshape(n, bins)
    known = least.copy()
    r, c = np.nonzero(least == _NONE)
    for order in _ORDERS:
        if not len(r):
            break
        got = known[r, order[c]]
        least[r, c] = got
        left = got == _NONE
        r, c = r[left], c[left]
    if len(r):
        least[r, c] = known[r].min(1)
    grouped = least.reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), np.uint64)
    for j in range(ROWS):
        key += grouped[:, :, j] * kernels._ODD[j]
    return kernels.mix(key + _BAND_SALT)


def _blocks(batch, text_at):
    body, starts, ends = kernels.string_buffers(batch.column(text_at))
    for i, j in kernels.row_blocks(starts, ends):
        if ends[j - 1] > starts[i]:
            yield i, body, lines(body, starts[i:j], ends[i:j])


def _sign(batches):
    seen: set[int] = set()
    for batch in batches:
        node, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, _, (row, number, h1, h2, values, of, _, _) in _blocks(batch, 2):
            n = len(row)
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for k, h in enumerate(h1.tolist()):
                if h not in seen:
                    fresh[k] = True
                    if len(seen) < _SEEN:
                        seen.add(h)
            place = np.cumsum(fresh) - 1
            mine = fresh[of]
            keys = band_keys(values[mine], place[of[mine]], int(fresh.sum()))
            flat = pa.array(kernels.signed(keys).ravel())
            offsets = pa.array(np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32), mask=np.append(~fresh, False))
            yield pa.record_batch(
                [pa.array(node[i + row]), pa.array(mark[i + row]), pa.array(number), pa.array(kernels.signed(h1)), pa.array(kernels.signed(h2)), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc", "mark", "line", "h1", "h2", "bands"],
            )


def _wanted(batches):
    """Rows (wanted line numbers, text) to the hash and text of those lines."""
    for batch in batches:
        wanted = batch.column(0)
        for i, body, (row, number, h1, _, _, _, a, b) in _blocks(batch, 1):
            if not len(row):
                continue
            numbers = {int(r): set(wanted[i + int(r)].as_py()) for r in np.unique(row)}
            take = [k for k, (r, x) in enumerate(zip(row.tolist(), number.tolist(), strict=True)) if x in numbers[r]]
            texts = [body[a[k] : b[k]].tobytes() for k in take]
            yield pa.record_batch([pa.array(kernels.signed(h1)[take]), pa.array(texts, pa.binary())], names=["node", "feats"])


def line_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of a column that holds one non-blank line in each row."""
    body, starts, ends = kernels.string_buffers(column)
    values, at = [], [np.zeros(1, np.int64)]
    for i, j in kernels.row_blocks(starts, ends):
        _, _, _, _, v, of, _, _ = lines(body, starts[i:j], ends[i:j])
        v, offsets = kernels.distinct_sorted(v, of, j - i)
        values.append(v)
        at.append(offsets[1:] + at[-1][-1])
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(at)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), text.alias("text"))


def _shared_signatures(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``shared_rows`` (key, node) of the classes, each signed from one task only as a rule.

    Copies of a line that lie in several tasks are signed in each. Rows of a class that may be one of these, by a bitmap,
    go on where a second bitmap may hold their task as the signer of their class. It holds the signer of every class that
    the first one lets through, so no class goes without its signatures; a few may come more than once.
    """
    again = classes.where("again").select("node")
    signers = stage(likely(classes.select("node", "signer"), again, "node").select(F.xxhash64("node", "signer").alias("signing")), "signers")
    rows = signed.where("bands is not null").select(F.col("bands").alias("keys"), F.col("h1").alias("node"), F.xxhash64("h1", "part").alias("signing"))
    rows = flagged(flagged(rows, again, "node", "again"), signers, "signing", "chosen").where("not again or chosen")
    found = shared_rows(rows.select("keys", "node"))
    drop(signers)
    return found


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-blank line: ``(doc, mark, line, first_doc, first_mark, first_line, kept)``.

    doc is the id (a null id counts as one id below all others), mark a hash of the row's text, line its number from 0.
    ``first_*`` name the line that its component keeps; ``kept`` is true where that is the line itself. Blank lines have
    no row. Null and empty texts have no lines. Repeated rows (same id and text) are one document: they keep and lose
    the same lines. Should two different normal forms ever share their first 64-bit hash, the second one shows it and
    all their lines are kept. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = _slim(docs, id_col, text_col)
    signed = slim.mapInArrow(_sign, "doc long, mark long, line long, h1 long, h2 long, bands array<long>")
    signed = stage(signed.withColumn("part", F.spark_partition_id()), "signed")
    place, signer = F.struct("doc", "mark", "line"), F.when(F.col("bands").isNotNull(), F.col("part"))
    classes = signed.groupBy(F.col("h1").alias("node")).agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.min("h2").alias("lo"), F.max("h2").alias("hi"), F.min(signer).alias("signer"), F.max(signer).alias("other")
    )
    classes = classes.where("lo = hi").select("node", "first", (F.col("first") != F.col("last")).alias("several"), "signer", (F.col("signer") != F.col("other")).alias("again"))
    classes = stage(classes, "classes")
    rows = _shared_signatures(signed, classes)
    found = stage(signed.select("doc", "mark", "line", "h1"), "lines")  # without the signatures, most of its bytes
    drop(signed)

    def fetch(nodes: DataFrame) -> DataFrame:
        places = likely(classes, nodes, "node").join(nodes, "node").select(F.xxhash64("first.doc", "first.mark").alias("place"), F.col("first.line").cast("int").alias("line"))
        places = stage(places.groupBy("place").agg(F.collect_list("line").alias("wanted")), "places")
        rows = slim.select(F.xxhash64("doc", "mark").alias("place"), "text").join(small_lists(places, "wanted"), "place")
        # lines are named by their text, so a place too many does no harm
        return rows.select("wanted", "text").mapInArrow(_wanted, "node long, feats binary").dropDuplicates(["node"])

    roots = link(rows, None, fetch, NUM, DEN, line_sets)
    # only rows that a join may change go through it; the bitmaps let a few more come along
    grouped = flagged(classes, roots, "node", "linked").where("several or linked").join(roots, "node", "left").where("several or root is not null")
    grouped = stage(grouped.select("node", "first", F.coalesce("root", "node").alias("root")), "grouped")
    keepers = stage(grouped.groupBy("root").agg(F.min("first").alias("keeper")), "keepers")
    shared = stage(grouped.join(keepers, "root").select(F.col("node").alias("h1"), "keeper"), "shared")
    rows = flagged(found, shared, "h1", "met")
    alone = rows.where("not met").select("doc", "mark", "line", place.alias("keeper"))
    rows = rows.where("met").join(shared, "h1", "left").select("doc", "mark", "line", F.coalesce("keeper", place).alias("keeper")).union(alone)
    keeper = F.col("keeper")
    out = rows.select("doc", "mark", "line", keeper["doc"].alias("first_doc"), keeper["mark"].alias("first_mark"), keeper["line"].alias("first_line"), (keeper == place).alias("kept"))
    result = stage(out, "line_classes")
    drop(found, classes, roots, grouped, keepers, shared)
    return result


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every line gone that is not the one its component keeps; all rows and columns stay.

    Blank lines stay where they are, and a text all of whose lines go becomes empty; null stays null. If there is a
    column ``n_chars`` it becomes the length of the new text.
    """
    classes = line_classes(docs, id_col, text_col)
    lost = classes.where("not kept").select("doc", "mark", "line").distinct().groupBy("doc", "mark")
    doc, mark, gone = unused(docs, "_doc", "_mark", "_gone")
    side = stage(lost.agg(F.collect_list(F.col("line").cast("int")).alias(gone)).withColumnsRenamed({"doc": doc, "mark": mark}), "gone")
    drop(classes)
    text = F.col(text_col).cast("string")
    key = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.coalesce(F.xxhash64(docs[text_col].cast("string")), F.lit(0)))
    rows = docs.join(small_lists(side, gone), (key[0] == F.col(doc)) & (key[1] == F.col(mark)), "left")
    pieces = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    shorter = F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "\n")
    changed = F.when(F.col(gone).isNotNull(), shorter).otherwise(text)
    columns = [changed.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    out = rows.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out
