"""Raw blocks, wire messages, snapshots, trees and the client requests."""

import hashlib
import struct
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.errors import IntegrityError, InvalidArgument, OutOfRange, Unavailable
from ledgerloom.operators import merkle
from ledgerloom.plans import derive
from ledgerloom.queries import _entries, sized_blocks
from ledgerloom.service import LightClientService, View, mined_answer, subtree_answer
from ledgerloom.sources import blobs, rawblocks, snapshot, wire
from ledgerloom.sources.blobs import compact_size


def fill(n, mark):
    return bytes([mark]) * n


def spend(k, tail):
    return fill(64 if tail == 288 else 32, 1) + fill(32, 100 + k) + fill(tail, 2)


def output(k, tail):
    return fill(32, 1) + fill(32, 110 + k) + fill(32, 120 + k) + fill(52, 130 + k) + fill(608 + tail, 3)


def actions(n):
    body = b"".join(fill(32, 1) + fill(32, 140 + k) + fill(32, 1) + fill(32, 150 + k) + fill(32, 160 + k) + fill(52, 170 + k) + fill(608, 4) for k in range(n))
    return compact_size(n) + body + (fill(41, 5) + compact_size(300) + fill(300, 6) + fill(64 * n + 64, 7) if n else b"")


def transparent(inputs, outputs):
    return compact_size(inputs) + b"".join(fill(36, 1) + compact_size(300) + fill(300, 2) + fill(4, 3) for _ in range(inputs)) + compact_size(outputs) + b"".join(fill(8, 1) + compact_size(5) + fill(5, 2) for _ in range(outputs))


def transaction(version, s=0, o=0, a=0, i=0, splits=0, ins=1, outs=2):
    head = struct.pack("<I", version | (1 << 31 if version >= 3 else 0)) + (struct.pack("<I", rawblocks.GROUPS[version]) if version >= 3 else b"")
    joins = lambda size: compact_size(splits) + fill(splits * size, 8) + (fill(96, 9) if splits else b"")
    t = transparent(ins, outs)
    if version == 1:
        return head + t + fill(4, 0)
    if version in (2, 3):
        return head + t + fill(4 if version == 2 else 8, 0) + joins(1802)
    if version == 4:
        shielded = compact_size(s) + b"".join(spend(k, 288) for k in range(s)) + compact_size(o) + b"".join(output(k, 192) for k in range(o))
        return head + t + fill(16, 0) + shielded + joins(1698) + (fill(64, 1) if s or o else b"")
    shielded = compact_size(s) + b"".join(spend(k, 32) for k in range(s)) + compact_size(o) + b"".join(output(k, 0) for k in range(o))
    if s or o:
        shielded += fill(8 + (32 if s else 0) + s * 256 + o * 192 + 64, 1)
    return head + fill(12, 0) + t + shielded + actions(a) + (actions(i) if version == 6 else b"")


CASES = [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 2, 3, 0, 0), (4, 0, 0, 0, 0), (5, 1, 0, 2, 0), (5, 0, 2, 0, 0), (6, 2, 2, 1, 3), (6, 0, 0, 0, 1)]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("splits", [0, 2])
def test_every_transaction_version(case, splits):
    version, s, o, a, i = case
    data = transaction(version, s, o, a, i, splits if version in (2, 3, 4) else 0)
    tx = rawblocks.parse_transaction(data, "ab", 7)
    assert [len(tx[k]) for k in ("spends", "outputs", "actions", "ironwood_actions")] == [s, o, a, i]
    assert all(x["nf"] == fill(32, 100 + k).hex() for k, x in enumerate(tx["spends"]))
    assert all((x["cmu"], x["ephemeral_key"], x["ciphertext"]) == (fill(32, 110 + k).hex(), fill(32, 120 + k).hex(), fill(52, 130 + k).hex()) for k, x in enumerate(tx["outputs"]))
    assert all((x["nullifier"], x["cmx"], x["ciphertext"]) == (fill(32, 140 + k).hex(), fill(32, 150 + k).hex(), fill(52, 170 + k).hex()) for k, x in enumerate(tx["actions"]))
    for n in range(0, len(data), max(1, len(data) // 60)):
        with pytest.raises(IntegrityError):
            rawblocks.parse_transaction(data[:n], "ab", 0)
    with pytest.raises(IntegrityError):
        rawblocks.parse_transaction(data + b"\0", "ab", 0)


def raw_block(height, transactions):
    header = struct.pack("<I", 4) + bytes.fromhex(f"{height - 1:064x}") + fill(64, 1) + struct.pack("<I", height * 75) + fill(36, 2)
    return header + compact_size(1344) + fill(1344, 3) + compact_size(len(transactions)) + b"".join(transactions)


def test_blocks_parse_in_bulk_and_refuse_damage(spark):
    rows = [(h, f"{h:064x}", raw_block(h, [transaction(*c[:1], *c[1:]) for c in CASES]), [f"{k:064x}" for k in range(len(CASES))]) for h in range(1, 9)]
    found = sorted(rawblocks.parse_blocks(spark.createDataFrame(rows, "height bigint, hash string, data binary, txids array<string>")).collect(), key=lambda r: r.height)
    assert [r.height for r in found] == list(range(1, 9)) and all(r.time == r.height * 75 and r.prev_hash == f"{r.height - 1:064x}" for r in found)
    assert all((r.sapling, r.orchard, r.ironwood) == (7, 3, 4) and len(r.vtx) == 5 for r in found)
    with pytest.raises(IntegrityError, match="count"):
        rawblocks.parse_block(1, "", rows[0][2], ["a"])
    with pytest.raises(IntegrityError):
        rawblocks.parse_block(1, "", rows[0][2] + b"\0", rows[0][3])
    for bad in (struct.pack("<I", 7 | 1 << 31), struct.pack("<I", 4), struct.pack("<II", 5 | 1 << 31, 1)):
        with pytest.raises(IntegrityError):
            rawblocks.parse_transaction(bad + fill(200, 0), "", 0)
    stored = rawblocks.parse_stored(3, "h", "p", 9, [(transaction(4, 1, 1), "x"), (transaction(1), "y")])
    assert len(stored["vtx"]) == 1 and stored["sapling"] == 1


def test_wire_round_trip_and_unknown_fields(spark, sf_dir):
    blocks = sized_blocks(spark, sf_dir).where("height < 60").drop("sapling", "orchard", "ironwood")
    back = {r.height: r for r in wire.from_wire(wire.to_wire(blocks)).collect()}
    for r in blocks.collect():
        b = back[r.height]
        assert (b.hash, b.prev_hash, b.time, b.sapling_size, b.orchard_size, b.ironwood_size) == (r.hash, r.prev_hash, r.time, r.sapling_size, r.orchard_size, r.ironwood_size)
        assert [(t["index"], t.txid, [s.nf for s in t.spends], [o.cmu for o in t.outputs], [a.nullifier for a in t.actions]) for t in b.vtx] == [
            (t["index"], t.txid, [s.nf for s in t.spends], [o.cmu for o in t.outputs], [a.nullifier for a in t.actions]) for t in r.vtx
        ]
    assert wire.decode(b"")["height"] == 0 and wire.encode({}) == b""
    assert wire.decode(wire.encode({"height": 300}) + b"\x7a\x03abc" + b"\x78\x05")["height"] == 300
    for bad in (b"\x10", b"\x3a\x05ab", b"\x13", b"\x15abcd"):
        with pytest.raises(IntegrityError):
            wire.decode(bad)


def test_wire_agrees_with_the_protobuf_runtime():
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="t.proto", syntax="proto3")
    for message, fields in wire.MESSAGES.items():
        m = file.message_type.add(name=message)
        for number, (name, kind) in fields.items():
            f = m.field.add(name=name, number=number, label=3 if isinstance(kind, list) else 1)
            inner = kind[0] if isinstance(kind, list) else kind
            f.type = {"u": 4, "b": 12}.get(inner, 11)
            if f.type == 11:
                f.type_name = f".{inner}"
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    block = message_factory.GetMessageClass(pool.FindMessageTypeByName("block"))
    row = {"height": 2**40, "hash": "ab" * 32, "time": 5, "sapling_size": 9, "ironwood_size": 70_000, "vtx": [{"index": 3, "txid": "cd" * 32, "outputs": [{"cmu": "01" * 32}, {}], "vout": [{"value": 7, "script_pub_key": "ff"}]}, {}]}
    data = wire.encode(row)
    theirs = block.FromString(data)
    assert theirs.height == 2**40 and theirs.sizes.ironwood_size == 70_000 and theirs.vtx[0].vout[0].value == 7 and len(theirs.vtx[0].outputs) == 2
    assert theirs.SerializeToString(deterministic=True) == data


def test_snapshot_export_is_incremental_and_verified(spark, sf_dir, tmp_path):
    blocks = sized_blocks(spark, sf_dir).select("height", "hash", "prev_hash", "time", "vtx", "sapling_size", "orchard_size", "ironwood_size").where("height < 1000")
    packed = blobs.pack_ranges(blocks).cache()
    entries = _entries(spark, sf_dir).drop("n_blocks").join(packed.select("start_height", "blob_digest", "blob_len"), "start_height").withColumn("epoch_end", F.lit(True))
    d = snapshot.SnapshotDirectory(spark, f"file://{tmp_path}/snap", b"key")
    when = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert d.export(packed, entries, 999, when) == {"manifest": "manifests/2026-01-02T030405Z.json", "written": 1}
    with pytest.raises(IntegrityError, match="exists"):
        d.export(packed, entries, 999, when)
    assert d.export(packed, entries, 999, when.replace(hour=4))["written"] == 0
    with pytest.raises(IntegrityError, match="range_blob"):
        d.export(packed, entries.withColumn("blob_digest", F.lit("0")), 999, when.replace(hour=5))
    got, through = d.manifest()
    assert through == 999 and got.count() == 1
    assert sorted(d.blocks().collect(), key=lambda r: r.height) == sorted(blocks.collect(), key=lambda r: r.height)
    with pytest.raises(IntegrityError, match="signature"):
        snapshot.SnapshotDirectory(spark, f"file://{tmp_path}/snap", b"other").manifest()
    tip = blocks.where("height = 999").first()
    assert snapshot.resume_point(-1, None, got, None)["action"] == "start"
    assert snapshot.resume_point(999, tip.hash, got, None)["action"] == "done"
    more = got.union(spark.createDataFrame([(1000, 1999, "e", 1, 1, 1, "", "", "", "d", 1, True)], got.schema))
    assert snapshot.resume_point(999, tip.hash, more, None) == {"action": "resume", "from": 1000}
    assert snapshot.resume_point(999, "x", more, "x")["action"] == "sealed tip" and snapshot.resume_point(999, "x", more, "y")["action"] == "reorganised tip"
    meta = spark.createDataFrame([(0, "verified"), (1000, "rejected"), (2000, "unverified")], "start_height bigint, state string")
    assert [r.start_height for r in snapshot.listing(meta, 0).collect()] == [0, 2000]


@pytest.mark.parametrize("n", [0, 1, 5, 8, 16, 19])
def test_trees_against_recursion(spark, n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    df = spark.createDataFrame(list(enumerate(leaves)), "position bigint, leaf string")
    join = lambda a, b: hashlib.sha256((a + b).encode()).hexdigest()

    def tree(part, height):
        if height == 0:
            return part[0] if part else merkle.EMPTY
        half = 1 << height - 1
        return join(tree(part[:half], height - 1), tree(part[half:], height - 1))

    assert merkle.frontier_root(df, 5).first().root == tree(leaves, 5)
    assert {r.subtree: r.root for r in merkle.subtree_roots(df, 2).collect()} == {k: tree(leaves[4 * k : 4 * k + 4], 2) for k in range(n // 4)}


@pytest.fixture(scope="module")
def view(spark, sf_dir):
    blocks = sized_blocks(spark, sf_dir).drop("sapling", "orchard", "ironwood").cache()
    outputs, spends = derive.outputs(spark, sf_dir), derive.spends(spark, sf_dir)
    point = "array<struct<prevout_txid: string, prevout_index: bigint>>"
    transparent = outputs.select("height", F.col("tx_index").alias("index"), F.array().cast(point).alias("vin"), F.array(F.struct("value")).alias("vout"))
    states = blocks.select("hash", "height", "time", F.lit("aa").alias("sapling_tree"), F.lit(None).cast("string").alias("orchard_tree"))
    roots = spark.createDataFrame([("sapling", k, f"r{k}", 10 * k + 5) for k in range(6)], "pool string, subtree bigint, root string, end_height bigint")
    return View(
        blocks.where("height <= 1400"), blocks.where("height > 1390"), 1400, 1499, outputs, spends, outputs.select("txid", "height", "tx_index"), transparent,
        derive.transactions(spark, sf_dir).where("height >= 1490").select(F.col("tx.txid").alias("txid"), "tx"), states, roots,
        spark.createDataFrame([(10, "a"), (5000, "b")], "height bigint, name string"), info={"vendor": "x"},
    )


def test_requests(view):
    s = LightClientService(view)
    assert s.latest_block().first().height == 1499
    assert s.block(3).first().height == 3 and s.block_nullifiers(3).first().sapling_size == 0
    assert [r.height for r in s.block_range(1395, 1405).collect()] == list(range(1395, 1406))
    assert [r.height for r in s.block_range_nullifiers(5, 2).collect()] == [5, 4, 3, 2]
    clear = s.block_range(1, 3, ["transparent"]).collect()
    assert all(r.vtx == [] and len(r.transparent) == 1 for r in clear)
    with pytest.raises(OutOfRange):
        s.block_range(0, 1500)
    known = view.outputs.first()
    assert s.transaction(known.txid).first().height == known.height and s.transaction("0" * 64).count() == 0
    assert s.transaction(view.pending.first().txid).first().height == 0
    with pytest.raises(InvalidArgument):
        s.transaction("ab")
    assert s.address_balance([known.address, known.address]).first().balance == s.address_balance([known.address]).first().balance
    assert {r.address for r in s.address_utxos([known.address], 0, 2).collect()} <= {known.address}
    assert s.address_txids([known.address], 0, 0).count() == view.outputs.where(F.col("address") == known.address).count()
    first = s.mempool_tx().first()
    assert s.mempool_tx([first.txid]).where(F.col("txid") == first.txid).count() == 0
    state = s.tree_state(7).first()
    assert (state.sapling_tree, state.orchard_tree) == ("aa", "") and s.latest_tree_state().first().height == 1499
    assert [(r.subtree, len(r.end_hash)) for r in s.subtree_roots("sapling", 2, 3).collect()] == [(2, 64), (3, 64), (4, 64)]
    info = s.lightd_info().first()
    assert (info.next_height, info.vendor) == (5000, "x")
    for bad in (lambda: s.subtree_roots("x"), lambda: s.subtree_roots("sapling", 70_000)):
        with pytest.raises(InvalidArgument):
            bad()


def test_readiness_and_freshness(view):
    from dataclasses import replace

    stale = LightClientService(replace(view, fresh=False))
    assert stale.block_range(0, 3).count() == 4 and stale.block(1499).count() == 1
    for bad in (stale.latest_block, lambda: stale.block_range(0, 1450), stale.mempool_stream):
        with pytest.raises(Unavailable):
            bad()
    down = LightClientService(replace(view, ready=False))
    for bad in (lambda: down.block(1), lambda: down.block_range(0, 1), down.ping, lambda: down.send_transaction(b"")):
        with pytest.raises(Unavailable):
            bad()


def test_node_answers(spark):
    rows = spark.createDataFrame([("a", "a", 5), ("b", "b", -1), ("c", "c", None)], "asked string, txid string, height bigint")
    assert [r.txid for r in mined_answer(rows).collect()] == ["a"]
    with pytest.raises(PySparkException):
        mined_answer(spark.createDataFrame([("a", "z", 5)], rows.schema)).collect()
    shape = "pool string, start_index int, subtrees array<struct<root: string, end_height: bigint>>"
    answer = spark.createDataFrame([("sapling", 4, [("x", 10), ("y", 20)])], shape)
    assert [(r.subtree, r.root) for r in subtree_answer(answer, "sapling", 4).collect()] == [(4, "x"), (5, "y")]
    with pytest.raises(PySparkException):
        subtree_answer(answer, "orchard", 4).collect()
    with pytest.raises(PySparkException):
        subtree_answer(spark.createDataFrame([("sapling", 65_535, [("x", 1), ("y", 2)])], shape), "sapling", 65_535).collect()
