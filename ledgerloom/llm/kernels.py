"""Vectorised text kernels over Arrow string columns.

All kernels work on the UTF-8 buffer of a column (or on its code points) for many rows at once, so that the
Python side of an operator costs nanoseconds a byte. Work is cut into blocks of about ``BLOCK`` bytes, which
bounds memory whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
#: One random word for each byte, so that the hash of a word depends on all 64 bits of each of its letters.
BYTE_WORD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["p"], _tables["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over all others."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first and one-past-last offset of each row; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), empty, empty
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return body, starts, ends


def row_blocks(starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    size = np.cumsum(ends - starts)
    i, n = 0, len(starts)
    while i < n:
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + limit, "right")))
        yield i, min(j, n)
        i = j


def words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = IS_SPACE, prefixes: tuple[int, ...] = ()):
    """Hash and row of every word of the rows, in order; words are runs of bytes outside ``gap``, A-Z in lower case.

    For each of ``prefixes`` a third part holds the hashes of the first so many bytes, 0 for words no longer than that.

    Long stretches are hashed piece by piece, cut at white space or at the end of a row.
    """
    if not len(starts) or ends[-1] <= starts[0]:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), *([np.zeros(0, np.uint64)] * len(prefixes)))
    parts, lo, hi = [], int(starts[0]), int(ends[-1])
    edges = np.unique(np.concatenate([starts, ends]))
    while lo < hi:
        cut = min(lo + BLOCK, hi)
        if cut < hi:
            spaces = np.flatnonzero(gap[body[lo:cut]])
            k = int(np.searchsorted(edges, cut, "right")) - 1
            best = max(lo + int(spaces[-1]) + 1 if len(spaces) else lo, int(edges[k]))
            if best <= lo:  # one word fills the block: take it whole
                later = edges[edges > lo]
                cut = int(later[0])
                spaces = np.flatnonzero(gap[body[lo:cut]])
                cut = lo + int(spaces[0]) + 1 if len(spaces) else cut
            else:
                cut = best
        parts.append(_words_of_block(body, starts, edges, lo, cut, gap, prefixes))
        lo = cut
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words_of_block(body, starts, edges, lo, hi, gap, prefixes):
    part = body[lo:hi]
    solid = ~gap[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[edges[(edges >= lo) & (edges <= hi)] - lo] = True
    edge[[0, -1]] = True
    first = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    last = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True))) + 1
    power, inverse = _powers(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(BYTE_WORD[LOWER[part]] * power[: len(part)], out=total[1:])
    hashed = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    heads = []
    for size in prefixes:
        longer = np.flatnonzero(last - first > size)
        head = np.zeros(len(first), np.uint64)
        head[longer] = mix((total[first[longer] + size] - total[first[longer]]) * inverse[first[longer]] + _U(size << 32))
        heads.append(head)
    return (hashed, np.searchsorted(starts, first + lo, "right") - 1, *heads)


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and their rows; a row with fewer words gives its whole sequence."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(rows, minlength=n_rows)
    m = n - width + 1
    if m > 0:
        full = np.zeros(m, np.uint64)
        for j in range(width):
            full += hashes[j : j + m] * _ODD[j]
        keep = rows[:m] == rows[width - 1 :]
        full, at = mix(full[keep]), rows[:m][keep]
    else:
        full, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        extra = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            extra[has] += hashes[begin[short[has]] + j] * _ODD[j]
        extra = mix(extra + count[short].astype(np.uint64) * _ODD[40])
        full, at = np.concatenate([full, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        full, at = full[order], at[order]
    return full, at


def distinct_sorted(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the offsets (n_rows + 1) at which the rows begin."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    for i in np.flatnonzero(count > 1):
        values[at[i] : at[i + 1]].sort()
    if len(values):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[fresh], rows[fresh]
        count = np.bincount(rows, minlength=n_rows)
        at = np.concatenate([[0], np.cumsum(count)])
    return values, at


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Wrapping sum of each segment of ``values`` that ``at`` bounds; 0 where a segment is empty."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def parity_sketch(values: np.ndarray) -> bytes:
    """Bitmap in which each value flips one bit. Two sets differ in at least as many values as their sketches in bits.

    Its size follows that of the set, so that it can tell large sets apart too.
    """
    n = len(values)
    bits = 1 << min(max((2 * n).bit_length(), 8), 16)
    where = (values >> _U(48)).astype(np.int64) & (bits - 1)
    odd = (np.bincount(where, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A longer sketch brought to ``size`` bytes: the low bits of a position stay what they are."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0) if len(sketch) > size else sketch


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
