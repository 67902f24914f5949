"""Column functions of the log: heights, bytes, names, times, metrics. All stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import MAX_U32, RANGE_SIZE


def range_start(height: Column, size: int = RANGE_SIZE) -> Column:
    """First height of the range that holds ``height``."""
    return height - F.pmod(height, F.lit(size))


def checked_height(height: Column) -> Column:
    """``height`` if it fits an unsigned 32-bit number, else null."""
    return F.when((height >= 0) & (height <= MAX_U32), height)


def saturate(count: Column) -> Column:
    """Counts stop at the greatest unsigned 32-bit number."""
    return F.least(count, F.lit(MAX_U32))


def display_order(hash_hex: Column) -> Column:
    """Byte-reversed lower-case hex."""
    return _reverse_hex(hash_hex)


def _reverse_hex(text: Column) -> Column:
    places = F.sequence(F.length(text) - 1, F.lit(1), F.lit(-2))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lower(text), i, F.lit(2))), "")


def le_uint(binary: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of up to 7 bytes at a fixed offset of a binary column."""
    part = F.lower(F.hex(F.substring(binary, at + 1, size)))
    return F.conv(_reverse_hex(part), 16, 10).cast("bigint")


def be_uint(binary: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(binary, at + 1, size)), 16, 10).cast("bigint")


def path_time(seconds: Column) -> Column:
    """UTC time as it stands in snapshot paths."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HHmmss'Z'")


def is_path_time(text: Column) -> Column:
    """Is the text such a time, exactly? A text that does not survive a round trip is not."""
    back = path_time(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HHmmss'Z'"))))
    return F.coalesce(back == text, F.lit(False))


def backoff(attempt: Column, base_ms: int = 200, cap_ms: int = 2_000) -> Column:
    """Milliseconds before retry ``attempt`` (from 0): doubling up to a cap."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), F.least(attempt, F.lit(30))), F.lit(cap_ms)).cast("bigint")


def height_label(height: Column) -> Column:
    """Whole thousands as ``12k``, any other height as it is."""
    return F.when(height % 1000 == 0, F.concat(F.floor(height / 1000).cast("string"), F.lit("k"))).otherwise(height.cast("string"))


def band_label(band: Column, next_band: Column, size: int) -> Column:
    """Heights that a row of a band covers: up to the next mark, which may lie several bands on; open if there is none."""
    start = height_label(band * size)
    return (
        F.when(next_band.isNull(), F.concat(start, F.lit("+")))
        .when(next_band == band + 1, start)
        .otherwise(F.concat(start, F.lit("-"), height_label(next_band * size)))
    )


def metric_name(line: Column) -> Column:
    """Name of a text exposition line, without labels and the ``_total`` suffix."""
    return F.regexp_replace(F.regexp_extract(line, r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1), "_total$", "")


def metric_label(line: Column, label: str) -> Column:
    """Value of one label of an exposition line, null if it has none."""
    found = F.regexp_extract(line, rf'[{{,]\s*{label}="([^"]*)"', 1)
    return F.when(found != "", found)


def metric_value(line: Column) -> Column:
    return F.regexp_extract(line, r"\s([-+0-9.eE]+|NaN)\s*$", 1).try_cast("double")


def total(columns: Iterable[Column]) -> Column:
    out = None
    for c in columns:
        out = c if out is None else out + c
    return out
