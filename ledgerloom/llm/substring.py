"""Repeated passages of over 50 words by content-defined chunking.

A gear hash rolls over the bytes of a text: each byte shifts it by one and adds a word of a random table, so after 32
bytes it depends on those 32 alone. Every window of 51 words has an anchor: the word end with the least hash among those
that have 32 bytes of the window before them. Windows in a row with one anchor make a chunk; chunks overlap, and their
borders depend on the text alone. A window that stands in two documents has the same anchor in both, however much was
inserted before it, so no passage is missed: chunks meet by the digest of their anchor, equal chunks are shared as a
whole, and where chunks of one anchor differ, their windows of 51 words are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import kernels
from ledgerloom.llm.linkage import likely, small, small_lists, unused
from ledgerloom.llm.ngramjoin import NO_ID
from ledgerloom.plans.runtime import ship, stage

#: Words that a passage must have, and those of them that 32 bytes before a word's end may take: one letter and one space each.
WORDS, BEHIND = 51, 16
#: Kinds of chunk beyond which an anchor is treated by itself.
MANY = 64
_WINDOW = 32
#: Least id that a document may bear; numbers below stand for null ids.
NAMED = NO_ID + 2**62
_GEAR = (kernels.BYTE_WORD >> np.uint64(16)).astype(np.uint32)


def gear(part: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the width of the sums."""
    h = _GEAR[part]
    reach = 1
    while reach < _WINDOW:
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = wider, reach * 2
    return h


def _word_places(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, one past the last byte, row) of the words of the rows that lie in ``part`` at starts, ends."""
    solid = ~kernels.IS_SPACE[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[starts] = edge[ends] = edge[0] = edge[-1] = True
    first = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    last = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    row = np.searchsorted(starts, first, "right") - 1
    inside = last <= ends[row]  # what lies between rows is of none
    return first[inside], last[inside], row[inside]


def _digests(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Digests of the stretches a to b of ``part``."""
    power, inverse = kernels._powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(kernels.BYTE_WORD[part] * power[: len(part)], out=total[1:])
    return kernels.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def anchored(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, one past the last byte, end of the anchor) of the chunks of rows that lie in ``part``."""
    first, last, row = _word_places(part, starts, ends)
    n = len(first) - WORDS + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = np.uint64(0xFFFFFFFF)
    least = gear(part)[last - 1].astype(np.uint64) << np.uint64(32) | low - np.arange(len(first), dtype=np.uint64)  # the last one of equals
    width, reach = WORDS - BEHIND, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    place = (low - (least[BEHIND:] & low)).astype(np.int64)
    window = np.flatnonzero(row[:n] == row[WORDS - 1 :])
    place = place[window]
    opens = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    closes = np.append(opens[1:], len(place))[: len(opens)] - 1
    return row[window[opens]], first[window[opens]], last[window[closes] + WORDS - 1], last[place[opens]]


def _chunks(batches):
    for batch in batches:
        doc, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        body, starts, ends = kernels.string_buffers(batch.column(2))
        for i, j in kernels.row_blocks(starts, ends):
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi <= lo:
                continue
            part = body[lo:hi]
            row, a, b, at = anchored(part, starts[i:j] - lo, ends[i:j] - lo)
            yield pa.record_batch(
                [
                    pa.array(doc[i + row]), pa.array(mark[i + row]), pa.array(a + lo - starts[i + row]), pa.array((b - a).astype(np.int32)),
                    pa.array(kernels.signed(_digests(part, at - _WINDOW, at))), pa.array(kernels.signed(_digests(part, a, b))),
                ],
                names=["doc", "mark", "start", "size", "anchor", "digest"],
            )


def _windows(batches):
    """Rows (text, chunks) to the windows of their chunks: (anchor, digest, lo, hi, k, a, b, window)."""
    for batch in batches:
        parts, chunks, held = [], [], 0
        for k in range(len(batch)):
            text = batch.column(0)[k].as_py().encode()
            for c in batch.column(1)[k].as_py():
                parts.append(text[c["start"] : c["start"] + c["size"]])
                chunks.append(c)
                held += c["size"]
                if held > kernels.BLOCK:
                    yield _window_rows(parts, chunks)
                    parts, chunks, held = [], [], 0
        if parts:
            yield _window_rows(parts, chunks)


def _window_rows(parts, chunks):
    part = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    starts = np.append(0, ends[:-1])
    first, last, row = _word_places(part, starts, ends)
    k = np.flatnonzero(row[: len(row) - WORDS + 1] == row[WORDS - 1 :])
    begins = np.searchsorted(row, np.arange(len(parts)))
    a, b, row = first[k], last[k + WORDS - 1], row[k]
    take = lambda name: pa.array(np.array([c[name] for c in chunks], np.int64)[row])
    columns = [take("anchor"), take("digest"), take("lo"), take("hi"), *(pa.array(x.astype(np.int32)) for x in (k - begins[row], a - starts[row], b - starts[row])), pa.array(kernels.signed(_digests(part, a, b)))]
    return pa.record_batch(columns, names=["anchor", "digest", "lo", "hi", "k", "a", "b", "window"])


def _named(docs: DataFrame, id_col: str, text_col: str):
    """Columns doc and mark: the id, and a hash of the text. Null ids are told apart by that hash, below all ids from NAMED on."""
    mark = F.coalesce(F.xxhash64(docs[text_col].cast("string")), F.lit(0))
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(mark, 2)).alias("doc"), mark.alias("mark")


def repeated_stretches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, mark, chunk, start, end, first)``: stretches all of whose windows of 51 words stand in other documents too.

    Each lies in the chunk that begins at ``chunk``; those of a document may overlap. ``first`` is true in the document
    of the least id that has the windows. Rows of one id and text are one document. Chunks and windows are
    compared by two digests of 64 bits, one of the whole and one of the bytes before the anchor.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    slim = docs.select(*_named(docs, id_col, text_col), text.alias("text"))
    chunks = stage(slim.mapInArrow(_chunks, "doc long, mark long, start long, size int, anchor long, digest long"), "chunks")
    across = stage(chunks.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("anchor"), "across")
    # an inner join: the optimizer would move a semi-join below the bitmap
    near = stage(likely(chunks, across, "anchor").join(across, "anchor"), "near")
    # equal chunks are one kind; only where an anchor has several kinds can a part of a chunk be shared
    where = F.min(F.struct("doc", "mark", "start", "size")).alias("at")
    kinds = stage(near.groupBy("anchor", "digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), where), "kinds")
    counts = stage(kinds.groupBy("anchor").agg(F.count("*").alias("n")), "counts")
    # anchors with many kinds do not go through a join that is dealt by them
    many = small(counts.where(F.col("n") > MANY).select("anchor"))
    rest = kinds.join(many, "anchor", "left_anti").join(counts.select("anchor", (F.col("n") > 1).alias("several")), "anchor")
    kinds = stage(rest.unionByName(kinds.join(many, "anchor", "left_semi").withColumn("several", F.lit(True))), "kinds_counted")
    whole = kinds.where("not several").select("anchor", "digest", F.lit(0).alias("a"), F.col("at.size").alias("b"), "lo")
    kind = F.struct("at.start", "at.size", "anchor", "digest", "lo", "hi")
    asked = kinds.where("several").groupBy(F.col("at.doc").alias("doc"), F.col("at.mark").alias("mark")).agg(F.collect_list(kind).alias("kinds"))
    rows = slim.join(small_lists(stage(asked, "asked"), "kinds"), ["doc", "mark"]).select("text", "kinds")
    windows = stage(rows.mapInArrow(_windows, "anchor long, digest long, lo long, hi long, k int, a int, b int, window long"), "windows")
    # equal windows have one anchor, whose digest is of other bits: both must agree
    shared = windows.groupBy("anchor", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("anchor", "window", "lo")
    met = windows.drop("lo", "hi").join(shared, ["anchor", "window"])
    own = Window.partitionBy("anchor", "digest").orderBy("a")
    opens = F.coalesce((F.lag("k").over(own) != F.col("k") - 1) | (F.lag("lo").over(own) != F.col("lo")), F.lit(True))
    runs = met.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own))
    parts = runs.groupBy("anchor", "digest", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("lo").alias("lo")).drop("run")
    pieces = stage(whole.unionByName(parts), "pieces")
    found = near.select("doc", "mark", "start", "anchor", "digest").join(pieces, ["anchor", "digest"])
    return found.select("doc", "mark", F.col("start").alias("chunk"), (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("end"), (F.col("doc") == F.col("lo")).alias("first"))


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping stretches of a document as one: ``(doc, mark, start, length, n_chunks, first)``."""
    before = Window.partitionBy("doc", "mark").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("doc", "mark").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.max("end").over(before) < F.col("start"), F.lit(True))
    runs = found.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(own))
    out = runs.groupBy("doc", "mark", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.collect_set("chunk")).cast("long").alias("n_chunks"), F.min("first").alias("first")
    )
    return out.select("doc", "mark", "start", (F.col("end") - F.col("start")).alias("length"), "n_chunks", "first")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage of a document: ``(<id>, start, length, n_chunks, first)``, in bytes of the UTF-8 text.

    A passage is a longest stretch that is covered by windows of 51 words that other documents have too, byte by byte;
    windows that overlap are one passage, whichever documents share them. Words end at ASCII white space. ``n_chunks``
    counts the chunks it was found in; ``first`` is true if no window of it stands in a document before this one, so
    that it is the copy to keep. Null and empty texts have none. Rows of null ids are documents told apart by their text,
    before all others, and come back as null. Repeated rows of one id and text are one document. Other columns are not read.
    """
    out = _merged(repeated_stretches(docs, id_col, text_col))
    return out.select(F.when(F.col("doc") >= NAMED, F.col("doc")).alias(id_col), "start", "length", "n_chunks", "first")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage cut out of the text that an earlier document has too; all rows and columns stay."""
    spans = _merged(repeated_stretches(docs, id_col, text_col).where("not first")).select("doc", "mark", F.col("start").alias("a"), F.col("length").alias("n"))
    doc, mark, cut = unused(docs, "_doc", "_mark", "_gone")
    gone = spans.groupBy(F.col("doc").alias(doc), F.col("mark").alias(mark)).agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias(cut))
    key = _named(docs, id_col, text_col)
    rows = docs.join(small_lists(stage(gone, "gone"), cut), (key[0] == F.col(doc)) & (key[1] == F.col(mark)), "left")
    raw = F.encode(F.col(text_col).cast("string"), "utf-8")
    # what stands between the spans: from the end of one to the start of the next
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda x: x["a"] + x["n"]))
    begins = F.concat(F.transform(cut, lambda x: x["a"]), F.array(F.octet_length(raw).cast("long")))
    piece = lambda a, b: F.hex(F.substr(raw, (a + 1).cast("int"), (b - a).cast("int")))
    left = F.decode(F.unhex(F.array_join(F.zip_with(ends, begins, piece), "")), "utf-8")
    changed = F.when(F.col(cut).isNotNull(), left).otherwise(F.col(text_col).cast("string"))
    return rows.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])
