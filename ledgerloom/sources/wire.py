"""Blocks in the tagged wire format of the light-client protocol, by field tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.errors import IntegrityError
from ledgerloom.plans.runtime import ship
from ledgerloom.sources.rawblocks import FULL_VTX

# fixed values: field numbers of the messages; a kind is "u" (number), "b" (bytes, hex here) or a message, [] repeats
MESSAGES = {
    "block": {2: ("height", "u"), 3: ("hash", "b"), 4: ("prev_hash", "b"), 5: ("time", "u"), 7: ("vtx", ["tx"]), 8: ("sizes", "sizes")},
    "sizes": {1: ("sapling_size", "u"), 2: ("orchard_size", "u"), 3: ("ironwood_size", "u")},
    "tx": {1: ("index", "u"), 2: ("txid", "b"), 3: ("fee", "u"), 4: ("spends", ["spend"]), 5: ("outputs", ["output"]), 6: ("actions", ["action"]), 7: ("vin", ["input"]), 8: ("vout", ["out"]), 9: ("ironwood_actions", ["action"])},
    "spend": {1: ("nf", "b")},
    "output": {1: ("cmu", "b"), 2: ("ephemeral_key", "b"), 3: ("ciphertext", "b")},
    "action": {1: ("nullifier", "b"), 2: ("cmx", "b"), 3: ("ephemeral_key", "b"), 4: ("ciphertext", "b")},
    "input": {1: ("prevout_txid", "b"), 2: ("prevout_index", "u")},
    "out": {1: ("value", "u"), 2: ("script_pub_key", "b")},
}
WIRE_BLOCK = f"height bigint, hash string, prev_hash string, time bigint, vtx {FULL_VTX}, sapling_size bigint, orchard_size bigint, ironwood_size bigint"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise IntegrityError("wire number", detail=str(at))
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & (2**64 - 1), at
        shift += 7


def encode(row: dict, message: str = "block") -> bytes:
    """Fields in order of their numbers; empty and zero ones are left out."""
    out = []
    for number, (name, kind) in sorted(MESSAGES[message].items()):
        value = {k: row.get(k) for _, (k, _) in MESSAGES["sizes"].items()} if kind == "sizes" else row.get(name)
        if kind == "u":
            if value:
                out += [_varint(number << 3), _varint(value)]
            continue
        parts = value or [] if isinstance(kind, list) else [value]
        for part in parts:
            body = bytes.fromhex(part or "") if kind == "b" else encode(part, kind[0] if isinstance(kind, list) else kind)
            if body or isinstance(kind, list):
                out += [_varint(number << 3 | 2), _varint(len(body)), body]
    return b"".join(out)


def decode(data: bytes, message: str = "block") -> dict:
    """All known fields; absent ones are 0, empty or an empty list. Unknown fields are skipped by their wire type."""
    fields = MESSAGES[message]
    row: dict = {name: [] if isinstance(kind, list) else 0 if kind == "u" else "" if kind == "b" else decode(b"", kind) for name, kind in fields.values()}
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _read_varint(data, at)
        elif wire in (1, 2, 5):
            size, at = _read_varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
            if at + size > len(data):
                raise IntegrityError("wire length", detail=f"{size} at {at}")
            value, at = data[at : at + size], at + size
        else:
            raise IntegrityError("wire type", detail=str(wire))
        if number not in fields:
            continue
        name, kind = fields[number]
        if (kind == "u") != (wire == 0) or wire in (1, 5):
            raise IntegrityError("wire type", detail=f"{name}: {wire}")
        if kind == "u":
            row[name] = value
        elif kind == "b":
            row[name] = value.hex()
        elif isinstance(kind, list):
            row[name].append(decode(value, kind[0]))
        else:
            row[name] = decode(value, kind)
    if message == "block":
        row |= row.pop("sizes")
    return row


def to_wire(blocks: DataFrame) -> DataFrame:
    """``(height, message binary)`` of nested blocks."""
    ship(blocks.sparkSession)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([pa.array([r["height"] for r in rows], pa.int64()), pa.array([encode(r) for r in rows], pa.binary())], names=["height", "message"])

    return blocks.mapInArrow(run, "height bigint, message binary")


def from_wire(messages: DataFrame) -> DataFrame:
    """Nested blocks of ``(message binary)``."""
    ship(messages.sparkSession)
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(WIRE_BLOCK)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(fields)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([decode(x.as_py()) for x in batch.column(0)], schema=shape)

    return messages.select("message").mapInArrow(run, WIRE_BLOCK)
