"""Packing of tokenised documents into sequences of fixed capacity, by a configuration linear program.

Only the histogram of piece lengths decides how full sequences get, and it has at most ``capacity`` entries however
many documents there are. The driver solves the covering program over configurations (sets of lengths that fit one
sequence) by multiplicative weights: lengths still short of cover weigh more, a knapsack table prices all
configurations at once, and the best one for each length gains a share. Shares are rounded down to whole sequences,
what is left is solved again, and a rest of at most one piece for each length is placed best fit, alike pieces at once.
Executors then number the pieces of each length without sorting them (a count per task and length is enough) and look
their place up in the plan.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.runtime import drop, ship, stage

#: Steps of a round of the program, share of its solution that is used before it is solved again, share of the pieces below
#: which a round counts as next to nothing, how sharply weights follow cover, and how near the best price a
#: configuration must be.
STEPS, STRIDE, LITTLE, SHARP, NEAR = 24, 0.3, 0.03, 4.0, 0.02
#: Texts of these characters only are split alike by both tokenizer libraries; all others go to the slower one.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ſ]")
_END = 0


@lru_cache(None)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(None)
def _fast(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer: str, ranks: str | None, pattern: str | None) -> list[int]:
    """Ids of the tokenizer file, without added special tokens. ``ranks`` names the same vocabulary in the faster format."""
    if ranks and "<|" not in text and not _PLAIN.search(text):
        return _fast(ranks, pattern).encode_ordinary(text)
    return _slow(tokenizer).encode(text, add_special_tokens=False).ids


def _cut(tokenizer, ranks, pattern, capacity):
    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "", tokenizer, ranks, pattern)
                ids.append(_END)
                flat = np.array(ids, "<u4")
                n = len(flat)
                first = n % capacity or capacity
                for k, end in enumerate(range(first, n + 1, capacity)):
                    at = 0 if k == 0 else end - capacity
                    size = end - at
                    row = (doc, k, at, size, zlib.crc32(flat[at:end].tobytes()), int(seen[size]))
                    seen[size] += 1
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            n = len(out[0])
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:]), pa.array(np.full(n, task, np.int64))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    return run


# --- the plan, on the histogram


def _knapsack(gain: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best gain for every capacity, and the length to take first there (0: none)."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    backwards = gain[::-1]
    top = capacity
    for c in range(1, capacity + 1):
        total = backwards[top - c : top] + best[:c]  # length c - i with what fits in i
        i = int(total.argmax())
        if total[i] > best[c - 1]:
            best[c], take[c] = total[i], c - i
        else:
            best[c] = best[c - 1]
    return best, take


def _fill(take: np.ndarray, room: int, left: np.ndarray) -> list[int]:
    """Lengths that the table puts into ``room``, none more often than it is left."""
    out: list[int] = []
    used: dict[int, int] = {}
    while room > 0:
        x = int(take[room])
        if x == 0:
            room -= 1 if take[room - 1] else 0
            while room > 0 and take[room] == 0:
                room -= 1
            continue
        if used.get(x, 0) >= left[x]:
            room -= 1
            continue
        used[x] = used.get(x, 0) + 1
        out.append(x)
        room -= x
    return out


def _shares(left: np.ndarray, capacity: int, steps: int) -> dict[tuple[int, ...], float]:
    """A near-optimal fractional cover of the histogram ``left`` by configurations."""
    lengths = np.flatnonzero(left)
    cover = np.zeros(capacity + 1)
    shares: dict[tuple[int, ...], float] = {}
    weight = np.zeros(capacity + 1)
    for step in range(steps):
        ratio = cover[lengths] / left[lengths]
        weight[lengths] = lengths / capacity * np.exp(-SHARP * (ratio - ratio.min()) / (ratio.mean() + 1e-9) if step else 0.0)
        gain = np.full(capacity, -1.0)
        gain[lengths - 1] = weight[lengths]
        best, take = _knapsack(gain, capacity)
        worth = weight[lengths] + best[capacity - lengths]
        good = lengths[worth >= (1 - NEAR) * worth.max()]
        for x in good.tolist():
            left[x] -= 1
            pattern = tuple(sorted([x, *_fill(take, capacity - x, left)], reverse=True))
            left[x] += 1
            names, times = np.unique(pattern, return_counts=True)
            amount = float((left[names] / times).min()) / (steps / 4)
            shares[pattern] = shares.get(pattern, 0.0) + amount
            cover[names] += amount * times
    return shares


def best_fit(left: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Longest first, each into the fullest sequence that has room, all pieces of a length and all alike sequences at once.

    Returns how often each configuration comes about. A step uses up a length or a group of alike sequences, so the work
    grows with the number of lengths and not with that of pieces.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    has = np.zeros(capacity + 1, bool)
    done: dict[tuple[int, ...], int] = {}

    def put(pattern, times, room):
        if room and times:
            groups.setdefault(room, []).append((pattern, times))
            has[room] = True
        elif times:
            done[pattern] = done.get(pattern, 0) + times

    for x in np.flatnonzero(left)[::-1].tolist():
        n = int(left[x])
        while n:
            rooms = np.flatnonzero(has[x:])
            if len(rooms):
                room = x + int(rooms[0])
                pattern, times = groups[room].pop()
                has[room] = bool(groups[room])
                fit = min(room // x, n)  # as many into one as go, then the next one
                some = min(times, n // fit)
                put(pattern, times - some, room)
                put(pattern + (x,) * fit, some, room - fit * x)
                n -= some * fit
            else:
                fit = min(capacity // x, n)
                put((x,) * fit, n // fit, capacity - fit * x)
                n -= n // fit * fit
    for some in groups.values():
        for pattern, times in some:
            done[pattern] = done.get(pattern, 0) + times
    return done


def configurations(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how often to use each, so that every piece of the histogram (index: length) is placed once.

    The program is solved for what is left until that is at most one piece for each length and half of all pieces, at
    every size of the input. Only this rest, which does not grow with the input, is placed best fit.
    """
    left = histogram.astype(np.int64).copy()
    used: dict[tuple[int, ...], int] = {}
    if left[capacity]:
        used[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    enough = min(np.count_nonzero(left), left.sum() // 2)
    while left.sum() > enough:
        before = left.sum()
        shares = _shares(left, capacity, STEPS)
        scale = STRIDE / max(1e-12, _overuse(shares, left, capacity))
        order = sorted(shares.items(), key=lambda p: (-p[1], p[0]))
        for rounded in (np.floor, np.ceil):  # up only where down leaves next to nothing
            if left.sum() > (1 - LITTLE) * before:
                _take(left, used, order, scale, rounded)
    for pattern, times in best_fit(left, capacity).items():
        used[pattern] = used.get(pattern, 0) + times
    return sorted(used.items(), reverse=True)


def _take(left, used, order, scale, rounded) -> None:
    """Configurations as often as their rounded shares say and pieces are left."""
    for pattern, share in order:
        names, times = np.unique(pattern, return_counts=True)
        n = int(min(rounded(share * scale), (left[names] // times).min()))
        if n > 0:
            used[pattern] = used.get(pattern, 0) + n
            left[names] -= n * times


def _overuse(shares, left, capacity) -> float:
    cover = np.zeros(capacity + 1)
    for pattern, share in shares.items():
        for x in pattern:
            cover[x] += share
    lengths = np.flatnonzero(left)
    return float(np.average(cover[lengths] / left[lengths], weights=left[lengths] * lengths))


def _places(plan: list[tuple[tuple[int, ...], int]], capacity: int):
    """Runs of places by length: (first run of each length, first piece, first sequence, offset in it)."""
    rows, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for x in pattern:
            rows.append((x, times, sequence, at))
            at += x
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    run_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    ahead = np.concatenate([[0], np.cumsum(table[:, 1])])[:-1]
    first = ahead - ahead[np.minimum(run_of[table[:, 0]], len(table) - 1)] if len(table) else ahead
    return run_of, first, table[:, 2], table[:, 3]


def _place(plan):
    def run(batches):
        run_of, first, sequence, offset = plan.value
        for x in batches:
            length, rank = (x.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            hit = np.zeros(len(length), np.int64)
            for size in np.unique(length):
                of = np.flatnonzero(length == size)
                a, b = run_of[size], run_of[size + 1]
                hit[of] = a + np.searchsorted(first[a:b], rank[of], "right") - 1
            placed = [pa.array(sequence[hit] + rank - first[hit]), pa.array(offset[hit])]
            yield pa.record_batch([*(x.column(i) for i in range(5)), *placed], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document is its ids and an end id 0; a null or empty text is the end id alone. One longer than ``capacity`` is
    cut into pieces of ``capacity``, what does not divide coming first. Sequences are numbered from 0 and filled without
    gaps. Repeated rows and null ids are documents like any other. ``tokenizer`` is a file of the ``tokenizers``
    library; ``ranks`` and ``pattern`` may name the same vocabulary for a faster encoder, used where both agree.
    Other columns are not read. An empty table has no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = stage(slim.mapInArrow(_cut(tokenizer, ranks, pattern, capacity), f"{shape}, nth long, task long"), "pieces")
    counts = stage(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    places = spark.sparkContext.broadcast(_places(configurations(histogram, capacity), capacity))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "length", ahead.alias("ahead"))
    ranked = pieces.join(offsets, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_place(places), f"{shape}, sequence_id long, offset long")
