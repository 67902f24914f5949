"""Binary blocks and packed ranges: selective decoding to nested rows, and encoding for exchange.

A packed range is a header (magic, version, start height, count), an offset table and the encoded blocks. Only what a
light client needs is kept of a block. Decoding checks every length before it reads; it runs in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.errors import IntegrityError
from ledgerloom.plans.runtime import ship
from ledgerloom.schema import BLOCK, RANGE_SIZE

MAGIC, VERSION = b"LLRG", 1
_HASH = 32


def compact_size(n: int) -> bytes:
    """Variable-length number: one byte, or a marker and 2, 4 or 8 bytes, always the shortest."""
    if n < 0xFD:
        return bytes([n])
    for marker, form, top in ((0xFD, "<H", 1 << 16), (0xFE, "<I", 1 << 32), (0xFF, "<Q", 1 << 64)):
        if n < top:
            return bytes([marker]) + struct.pack(form, n)
    raise IntegrityError("too large", detail=str(n))


class Cursor:
    """Reads forward in a byte string and refuses to read beyond it."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise IntegrityError("truncated", detail=f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def size(self, item: int = 1) -> int:
        """A compact size that what is left can hold, ``item`` bytes each. Longer forms than needed are refused."""
        first = self.take(1)[0]
        n = first if first < 0xFD else self.number({0xFD: "<H", 0xFE: "<I", 0xFF: "<Q"}[first])
        if compact_size(n)[0] != first:
            raise IntegrityError("not canonical", detail=str(n))
        if n * item > len(self.data) - self.at:
            raise IntegrityError("truncated", detail=f"{n} items of {item} bytes")
        return n

    def done(self) -> None:
        if self.at != len(self.data):
            raise IntegrityError("trailing bytes", detail=str(len(self.data) - self.at))


_LISTS = (("spends", ("nf",)), ("outputs", ("cmu",)), ("actions", ("nullifier", "cmx")), ("ironwood_actions", ("nullifier", "cmx")))
_SIZES = ("sapling_size", "orchard_size", "ironwood_size")


def encode_block(row: dict) -> bytes:
    out = [struct.pack("<BI", VERSION, row["height"]), bytes.fromhex(row["hash"]), bytes.fromhex(row["prev_hash"]), struct.pack("<I", row["time"])]
    out += [struct.pack("<Q", row[s]) for s in _SIZES]
    out.append(compact_size(len(row["vtx"])))
    for tx in row["vtx"]:
        out += [compact_size(tx["index"]), bytes.fromhex(tx["txid"])]
        for name, fields in _LISTS:
            out.append(compact_size(len(tx[name])))
            out += [bytes.fromhex(item[f]) for item in tx[name] for f in fields]
    return b"".join(out)


def decode_block(data: bytes, want: frozenset[str] = frozenset(n for n, _ in _LISTS)) -> dict:
    """A block; lists that are not wanted are skipped unread and come back empty."""
    c = Cursor(data)
    version, height = c.number("<B"), c.number("<I")
    if version != VERSION:
        raise IntegrityError("version", height, str(version))
    row = {"height": height, "hash": c.take(_HASH).hex(), "prev_hash": c.take(_HASH).hex(), "time": c.number("<I")}
    row |= {s: c.number("<Q") for s in _SIZES}
    row["vtx"] = []
    for _ in range(c.size(1 + _HASH + len(_LISTS))):
        tx = {"index": c.size(0), "txid": c.take(_HASH).hex()}
        for name, fields in _LISTS:
            n = c.size(_HASH * len(fields))
            if name in want:
                tx[name] = [{f: c.take(_HASH).hex() for f in fields} for _ in range(n)]
            else:
                c.take(n * _HASH * len(fields))
                tx[name] = []
        row["vtx"].append(tx)
    c.done()
    return row


def encode_range(rows: list[dict]) -> bytes:
    """A whole, aligned, linked range."""
    start = rows[0]["height"] if rows else 0
    if len(rows) != RANGE_SIZE or start % RANGE_SIZE:
        raise IntegrityError("incomplete_range", start)
    for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
        if b["height"] != a["height"] + 1 or b["prev_hash"] != a["hash"]:
            raise IntegrityError("block_link", start + k + 1)
    blocks = [encode_block(r) for r in rows]
    offsets, at = [], 0
    for b in blocks:
        offsets.append(at)
        at += len(b)
    return MAGIC + struct.pack("<BII", VERSION, start, len(rows)) + struct.pack(f"<{len(rows)}I", *offsets) + b"".join(blocks)


class RangeReader:
    """Random access to the blocks of a packed range."""

    def __init__(self, data: bytes):
        c = Cursor(data)
        if c.take(4) != MAGIC or c.number("<B") != VERSION:
            raise IntegrityError("range_version")
        self.start, n = c.number("<I"), c.number("<I")
        if n != RANGE_SIZE or self.start % RANGE_SIZE:
            raise IntegrityError("range_start", self.start)
        self.offsets = [*struct.unpack(f"<{n}I", c.take(4 * n)), len(data) - c.at]
        self.body = data[c.at :]

    def __len__(self) -> int:
        return RANGE_SIZE

    def block(self, i: int, **options) -> dict:
        row = decode_block(self.body[self.offsets[i] : self.offsets[i + 1]], **options)
        if row["height"] != self.start + i:
            raise IntegrityError("block_height", self.start + i)
        return row


def encode_blocks(blocks: DataFrame) -> DataFrame:
    """``(height, payload binary)`` of nested blocks."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["height"] for r in rows], pa.int64()), pa.array([encode_block(r) for r in rows], pa.binary())], names=["height", "payload"])

    return blocks.mapInArrow(run, "height bigint, payload binary")


def decode_blocks(payloads: DataFrame, want: tuple[str, ...] | None = None) -> DataFrame:
    """Nested blocks of ``(payload binary)``; ``want`` names the lists to decode."""
    ship(payloads.sparkSession)
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(BLOCK)
    options = {} if want is None else {"want": frozenset(want)}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(fields)
        for batch in batches:
            rows = [decode_block(x.as_py(), **options) for x in batch.column(0)]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return payloads.select("payload").mapInArrow(run, BLOCK)


def pack_ranges(blocks: DataFrame) -> DataFrame:
    """``(start_height, blob binary, blob_len, blob_digest)``: one row per whole range. A group is one range of 1,000 rows.

    Blocks that are dealt by a column ``range_id`` are packed where they are.
    """
    ship(blocks.sparkSession)
    ranged = blocks if "range_id" in blocks.columns else blocks.withColumn("range_id", F.floor(F.col("height") / RANGE_SIZE))

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values("height").to_dict("records")
        return pd.DataFrame({"start_height": [rows[0]["height"] // RANGE_SIZE * RANGE_SIZE], "blob": [encode_range(rows)]})

    packed = ranged.groupBy("range_id").applyInPandas(run, "start_height bigint, blob binary")
    return packed.withColumn("blob_len", F.octet_length("blob").cast("bigint")).withColumn("blob_digest", F.sha2("blob", 256))


def unpack_ranges(packed: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Nested blocks of packed ranges; with ``places (start_height, place)`` only the blocks at those places."""
    ship(packed.sparkSession)
    rows = packed.select("start_height", "blob")
    if places is not None:
        rows = rows.join(places.groupBy("start_height").agg(F.collect_set("place").alias("places")), "start_height")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<bigint>"))

    def run(batches):
        for batch in batches:
            for blob, wanted in zip(batch.column(1), batch.column(2), strict=True):
                reader = RangeReader(blob.as_py())
                for i in sorted(wanted.as_py()) if wanted.is_valid else range(len(reader)):
                    yield pa.record_batch([pa.array([reader.body[reader.offsets[i] : reader.offsets[i + 1]]], pa.binary())], names=["payload"])

    return decode_blocks(rows.mapInArrow(run, "payload binary"))


#: Added items by the size that counts them.
_ADDS = {"sapling_size": "outputs", "orchard_size": "actions", "ironwood_size": "ironwood_actions"}
# fixed values: the named checks of a packed range, in the order in which they are made
CHECKS = ("blob_length", "blob_digest", "range_version", "decode", "start_height", "start_link", "hash_chain", "tree_sizes", "end_hash", "end_tree_sizes")


def range_failure(blob: bytes | None, entry: dict) -> tuple[int, str] | None:
    """(height, check) of the first check that a packed range fails, or None.

    ``entry`` says what the manifest does (start_height, end_hash, sizes, blob_len, blob_digest) and, as ``previous``, what
    it says of the range before (None: this one is the first). Checks of the whole range fail at its start.
    """
    start = entry["start_height"]
    if blob is None or len(blob) != entry["blob_len"]:
        return start, "blob_length"
    if hashlib.sha256(blob).hexdigest() != entry["blob_digest"]:
        return start, "blob_digest"
    if blob[:4] != MAGIC or blob[4:5] != bytes([VERSION]):
        return start, "range_version"
    try:
        reader = RangeReader(blob)
    except IntegrityError:
        return start, "decode"
    if reader.start != start:
        return start, "start_height"
    last = entry["previous"] or {"end_hash": "0" * 64} | dict.fromkeys(_ADDS, 0)
    above, sizes = last["end_hash"], {s: last[s] for s in _ADDS}
    for i in range(len(reader)):
        try:
            row = reader.block(i)
        except IntegrityError:
            return start + i, "decode"
        if row["prev_hash"] != above:
            return start + i, "hash_chain" if i else "start_link"
        sizes = {s: n + sum(len(tx[_ADDS[s]]) for tx in row["vtx"]) for s, n in sizes.items()}
        if any(row[s] != n for s, n in sizes.items()):
            return start + i, "tree_sizes"
        above = row["hash"]
    if above != entry["end_hash"]:
        return start + RANGE_SIZE - 1, "end_hash"
    if any(sizes[s] != entry[s] for s in _ADDS):
        return start + RANGE_SIZE - 1, "end_tree_sizes"
    return None


class CheckedRanges:
    """Packed ranges that have passed every check against their entries: what a store installs. Only ``check`` makes one.

    ``packed (start_height, blob)`` may be made anew when it is read again: who takes it compares each blob with the
    digest that was checked (``blobs``). The entries must not change, so hand in a table that is written.
    """

    def __init__(self, packed: DataFrame, entries: DataFrame, *, _proof: object = None):
        if _proof is not _PROOF:
            raise TypeError("CheckedRanges.check makes checked ranges")
        self.packed, self.entries = packed, entries

    @classmethod
    def check(cls, packed: DataFrame, entries: DataFrame) -> CheckedRanges:
        bad = failures(packed, entries).orderBy("start_height").first()
        if bad is not None:
            raise IntegrityError(bad["check"], bad["height"])
        return cls(packed, entries, _proof=_PROOF)

    def blobs(self) -> DataFrame:
        """``(start_height, blob)`` of the entries; a blob that is not the one that was checked fails the query."""
        rows = self.packed.select("start_height", "blob").join(_known(self.entries.select("start_height", "blob_digest")), "start_height")
        checked = F.when(F.sha2("blob", 256) == F.col("blob_digest"), F.col("blob")).otherwise(F.raise_error(F.lit("blob_digest")).cast("binary"))
        return rows.select("start_height", checked.alias("blob"))


_PROOF = object()
#: Entries, one for a thousand blocks, that are sent to all executors (about 500 bytes each); more are joined through a shuffle.
_MOST_KNOWN = 200_000


def _known(entries: DataFrame) -> DataFrame:
    """Entries that go to the blobs if they are few enough, so that no blob moves."""
    return F.broadcast(entries) if entries.limit(_MOST_KNOWN + 1).count() <= _MOST_KNOWN else entries


def failures(packed: DataFrame, entries: DataFrame) -> DataFrame:
    """``(start_height, height, check)`` of the entries whose range fails, and the first check that it fails.

    Entries ``(start_height, end_hash, sapling_size, orchard_size, ironwood_size, blob_len, blob_digest)``; a range is
    checked by itself, its first link and sizes against the entry before it. Each range is one row of one task.
    """
    ship(packed.sparkSession)
    known = ["end_hash", *_ADDS]
    before = entries.select((F.col("start_height") + RANGE_SIZE).alias("start_height"), F.struct(*known).alias("previous"))
    rows = entries.select("start_height", *known, "blob_len", "blob_digest").join(before, "start_height", "left")

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                found.append((row["start_height"], *(range_failure(row.pop("blob"), row) or (None, None))))
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["start_height", "height", "check"])

    # what has been checked comes back without its blob, and an entry that has not was without one
    checked = packed.select("start_height", "blob").join(_known(rows), "start_height").mapInArrow(run, "start_height bigint, height bigint, check string")
    missing = F.struct(F.col("start_height").alias("height"), F.lit(CHECKS[0]).alias("check"))
    seen = checked.select("start_height", F.struct("height", "check").alias("f"))
    return entries.select("start_height").join(seen, "start_height", "left").select("start_height", F.coalesce("f", missing).alias("f")).select("start_height", "f.height", "f.check").where("check is not null")


class _Segment(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _RangeFiles(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(options["paths"].split(","))

    def partitions(self):
        return [_Segment(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            reader = RangeReader(f.read())
        for i in range(len(reader)):
            row = reader.block(i)
            yield (row["height"], row["hash"], row["prev_hash"], row["time"], [tuple(tx[k] for k in ("index", "txid", "spends", "outputs", "actions", "ironwood_actions")) for tx in row["vtx"]], *(row[s] for s in _SIZES))


class RangeFileSource(DataSource):
    """``spark.read.format("ledger_ranges").option("paths", "a,b")``: one partition for each packed range file."""

    @classmethod
    def name(cls) -> str:
        return "ledger_ranges"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema):
        return _RangeFiles(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RangeFileSource)
