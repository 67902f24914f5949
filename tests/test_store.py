"""Generations, reorganisations, binary ranges and streams."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.errors import IntegrityError, OutOfRange
from ledgerloom.plans import derive
from ledgerloom.queries import sized_blocks
from ledgerloom.schema import BLOCK, RANGE_SIZE
from ledgerloom.sources import blobs
from ledgerloom.sources.store import Store
from ledgerloom.streaming import head


def chain(spark, low, high, branch="", fork=-1):
    """Blocks low..high; above ``fork`` they belong to a branch."""
    name = lambda h: F.when(h > fork, derive.digest(branch, h)).otherwise(derive.digest("", h))
    h = F.col("height")
    rows = spark.range(low, high + 1).withColumnRenamed("id", "height")
    empty = F.array().cast(BLOCK.split("vtx ")[1].split(", sapling_size")[0])
    zero = F.lit(0).cast("bigint")
    return rows.select("height", name(h).alias("hash"), F.when(h == 0, F.lit("0" * 64)).otherwise(name(h - 1)).alias("prev_hash"), h.alias("time"), empty.alias("vtx"), zero.alias("sapling_size"), zero.alias("orchard_size"), zero.alias("ironwood_size"))


def test_append_seals_whole_ranges_by_depth(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    s = store.append(store.snapshot(), chain(spark, 0, 1098))
    assert (s.tip, s.state["sealed_through"], s.sealed.count()) == (1098, -1, 0)
    t = store.append(s, chain(spark, 1099, 2209))
    assert (t.tip, t.state["sealed_through"], t.sealed.count(), t.mutable.count()) == (2209, 1999, 2000, 210)
    assert s.blocks().count() == 1099  # an old generation stays readable
    assert t.sealed_range(1000).count() == 1000
    with pytest.raises(OutOfRange):
        t.sealed_range(5)
    with pytest.raises(IntegrityError, match="stale"):
        store.append(s, chain(spark, 1099, 1100))
    with pytest.raises(IntegrityError, match="continuity"):
        store.append(t, chain(spark, 2215, 2220))
    with pytest.raises(IntegrityError, match="continuity"):
        store.append(t, chain(spark, 2210, 2211, "other", 2000))


def test_replacements(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    s = store.append(store.snapshot(), chain(spark, 0, 2209))
    shallow = store.replace_suffix(s, 2100, chain(spark, 2101, 2150, "b", 2100))
    assert shallow.tip == 2150 and shallow.blocks().where("height > 2100").count() == 50
    back = store.replace_suffix(shallow, 2050, chain(spark, 0, -1))
    assert back.tip == 2050
    with pytest.raises(IntegrityError, match="sealed"):
        store.replace_suffix(back, 1500, chain(spark, 1501, 1502, "b", 1500))
    with pytest.raises(IntegrityError, match="replacement"):
        store.replace_suffix(back, 9999, chain(spark, 0, -1))
    meta = [(s0, back.sealed.where(F.col("height") == s0 + 999).first().hash, 0, 0, 0, "verified") for s0 in (0, 1000)]
    marked = store.put_range_meta(back, spark.createDataFrame(meta, back.range_meta.schema))
    with pytest.raises(IntegrityError, match="range_end_hash"):
        store.put_range_meta(marked, spark.createDataFrame([(0, "no", 0, 0, 0, "verified")], back.range_meta.schema))
    deep = store.replace_deep(marked, 1200, chain(spark, 1201, 2400, "d", 1200))
    assert (deep.tip, deep.state["sealed_through"], deep.range_meta.count()) == (2400, 1999, 1)
    assert deep.blocks().count() == 2401 and deep.hash_index.count() == 2401


def test_head_follows_extensions_and_reorganisations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    s = head.reconcile(store, store.snapshot(), chain(spark, 0, 1300), 1300)
    assert (s.tip, s.state["sealed_through"]) == (1290, 999)
    s = head.reconcile(store, s, chain(spark, 1250, 1400), 1400)
    assert s.tip == 1390
    s = head.reconcile(store, s, chain(spark, 1250, 1420, "b", 1350), 1420)
    assert s.tip == 1410 and s.blocks().where("height = 1351").first().hash == chain(spark, 1351, 1351, "b", 1350).first().hash
    s = head.reconcile(store, s, chain(spark, 0, 1500, "c", 900), 1500)
    assert s.tip == 1490 and s.blocks().count() == 1491 and s.state["sealed_through"] == 999


def test_stream_equals_batch(spark, tmp_path):
    polls = tmp_path / "polls"
    for k, (low, high) in enumerate(((0, 150), (100, 300), (200, 450))):
        chain(spark, low, high).coalesce(1).write.parquet(str(polls / str(k)))
    store = Store(spark, str(tmp_path / "store"))
    live = spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(polls))
    head.follow(live, store, str(tmp_path / "progress")).awaitTermination()
    s = store.snapshot()
    assert s.tip == 440 and sorted(r.height for r in s.blocks().select("height").collect()) == list(range(441))


def test_block_codec_round_trip(spark, sf_dir):
    blocks = sized_blocks(spark, sf_dir).select("height", "hash", "prev_hash", "time", "vtx", "sapling_size", "orchard_size", "ironwood_size").where("height < 1000")
    packed = blobs.pack_ranges(blocks).cache()
    row = packed.first()
    assert row.blob_len == len(row.blob) and packed.count() == 1
    key = lambda df: sorted(df.collect(), key=lambda r: r.height)
    assert key(blobs.unpack_ranges(packed)) == key(blocks)
    places = spark.createDataFrame([(0, 3), (0, 998)], "start_height bigint, place bigint")
    assert [r.height for r in key(blobs.unpack_ranges(packed, places))] == [3, 998]
    only = blobs.decode_blocks(blobs.encode_blocks(blocks.where("height < 50")), ("spends",))
    assert all(t.outputs == [] and t.actions == [] for r in only.collect() for t in r.vtx)


def test_range_file_source(spark, sf_dir, tmp_path):
    blocks = sized_blocks(spark, sf_dir).select("height", "hash", "prev_hash", "time", "vtx", "sapling_size", "orchard_size", "ironwood_size").where("height < 1000")
    (tmp_path / "r").write_bytes(blobs.pack_ranges(blocks).first().blob)
    blobs.register(spark)
    found = spark.read.format("ledger_ranges").option("paths", str(tmp_path / "r")).load()
    assert found.where("height between 10 and 12").count() == 3


def _row(h):
    return {"height": h, "hash": f"{h:064x}", "prev_hash": f"{h - 1:064x}" if h else "0" * 64, "time": h, "vtx": [], "sapling_size": 0, "orchard_size": 0, "ironwood_size": 0}


def test_codec_refuses_damage():
    data = blobs.encode_block(_row(5) | {"vtx": [{"index": 300, "txid": "ab" * 32, "spends": [{"nf": "cd" * 32}], "outputs": [], "actions": [], "ironwood_actions": []}]})
    assert blobs.decode_block(data)["vtx"][0]["index"] == 300
    for n in range(len(data)):
        with pytest.raises(IntegrityError):
            blobs.decode_block(data[:n])
    with pytest.raises(IntegrityError, match="trailing"):
        blobs.decode_block(data + b"\0")
    with pytest.raises(IntegrityError, match="not canonical"):
        blobs.Cursor(b"\xfd\x05\x00").size()
    rows = [_row(h) for h in range(RANGE_SIZE)]
    blob = blobs.encode_range(rows)
    assert blobs.RangeReader(blob).block(999)["height"] == 999
    with pytest.raises(IntegrityError, match="incomplete"):
        blobs.encode_range(rows[1:])
    with pytest.raises(IntegrityError, match="block_link"):
        blobs.encode_range([*rows[:500], rows[500] | {"prev_hash": "f" * 64}, *rows[501:]])


def packed(spark, low, high):
    rows = blobs.pack_ranges(chain(spark, low, high)).collect()
    of = lambda r: (r.start_height, derive_hash(r.start_height + 999), 0, 0, 0, r.blob_len, r.blob_digest)
    entries = spark.createDataFrame([of(r) for r in rows], "start_height bigint, end_hash string, sapling_size bigint, orchard_size bigint, ironwood_size bigint, blob_len bigint, blob_digest string")
    return spark.createDataFrame([(r.start_height, r.blob) for r in rows], "start_height bigint, blob binary"), entries


def derive_hash(h):
    import hashlib

    return hashlib.sha256(str(h).encode()).hexdigest()


def test_install_takes_only_checked_ranges_that_continue(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    files, entries = packed(spark, 0, 2999)
    first = store.install(store.snapshot(), blobs.CheckedRanges.check(files, entries.where("start_height < 2000")))
    assert (first.tip, first.state["sealed_through"], first.sealed.count(), first.range_meta.count(), first.hash_index.count()) == (1999, 1999, 2000, 2, 2000)
    later = blobs.CheckedRanges.check(files, entries).entries  # one range by itself would lack the entry before it
    with pytest.raises(IntegrityError, match="continuity"):
        store.install(first, blobs.CheckedRanges.check(files, later))
    with pytest.raises(TypeError):
        store.install(first, (files, entries))
    with pytest.raises(TypeError):
        blobs.CheckedRanges(files, entries)
    with pytest.raises(IntegrityError, match="blob_length"):
        blobs.CheckedRanges.check(files.where("start_height = 0"), entries)
    assert store.install(first, blobs.CheckedRanges.check(files, entries.where("start_height > 9000"))) is first
    grown = store.append(first, chain(spark, 2000, 2100))
    with pytest.raises(IntegrityError, match="continuity"):
        store.install(grown, blobs.CheckedRanges.check(files, entries))


def test_range_failures_are_named_in_order(spark):
    (row,) = blobs.pack_ranges(chain(spark, 0, 999)).collect()
    blob = bytes(row.blob)
    import hashlib

    def entry(data, **more):
        sizes = dict.fromkeys(("sapling_size", "orchard_size", "ironwood_size"), 0)
        return {"start_height": 0, "end_hash": derive_hash(999), "blob_len": len(data), "blob_digest": hashlib.sha256(data).hexdigest(), "previous": None} | sizes | more

    assert blobs.range_failure(blob, entry(blob)) is None
    assert blobs.range_failure(None, entry(blob)) == (0, "blob_length")
    assert blobs.range_failure(blob + b"x", entry(blob)) == (0, "blob_length")
    assert blobs.range_failure(blob, entry(blob, blob_digest="0" * 64)) == (0, "blob_digest")
    for at, check in ((0, "range_version"), (5, "decode"), (9, "decode")):
        bad = blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :]
        assert blobs.range_failure(bad, entry(bad)) == (0, check)
    assert blobs.range_failure(blob, entry(blob, start_height=1000, previous=None)) == (1000, "start_height")
    assert blobs.range_failure(blob, entry(blob, previous={"end_hash": "1" * 64, "sapling_size": 0, "orchard_size": 0, "ironwood_size": 0})) == (0, "start_link")
    body = 13 + 4 * RANGE_SIZE
    size = (len(blob) - body) // RANGE_SIZE
    link = bytearray(blob)
    link[body + 7 * size + 5 + 32] ^= 1  # the previous hash of block 7
    assert blobs.range_failure(bytes(link), entry(link)) == (7, "hash_chain")
    grown = bytearray(blob)
    grown[body + 9 * size + 5 + 64 + 4] ^= 1
    assert blobs.range_failure(bytes(grown), entry(grown)) == (9, "tree_sizes")
    assert blobs.range_failure(blob, entry(blob, end_hash="2" * 64)) == (999, "end_hash")
    assert blobs.range_failure(blob, entry(blob, orchard_size=1)) == (999, "end_tree_sizes")


def test_reorganisations_rewrite_no_sealed_folder(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    s = store.append(store.snapshot(), chain(spark, 0, 5209))
    for k in (4500, 3100, 2999):
        s = store.replace_deep(s, k, chain(spark, k + 1, 5300, f"b{k}", k))
        assert (s.tip, s.blocks().count(), s.hash_index.count(), s.blocks().select("hash").distinct().count()) == (5300, 5301, 5301, 5301)
    first = s.state["sealed"][0]
    assert first[1] == 2999 and len({f if isinstance(f, str) else f[0] for f in s.state["sealed"]}) == len(s.state["sealed"])
    whole = store.compact(s, most=1)
    assert len(whole.state["sealed"]) == len(whole.state["hash_index"]) == 1
    assert whole.blocks().exceptAll(s.blocks()).isEmpty() and s.blocks().exceptAll(whole.blocks()).isEmpty()
    assert store.compact(whole) is whole


def test_small_files_are_published_whole_or_not_at_all(spark, tmp_path):
    from ledgerloom.plans.runtime import publish

    path = f"file://{tmp_path}/x/one.json"
    publish(spark, b"1", path)
    with pytest.raises(FileExistsError):
        publish(spark, b"2", path)
    assert (tmp_path / "x/one.json").read_bytes() == b"1"
    publish(spark, b"3", path, replace=True)
    assert (tmp_path / "x/one.json").read_bytes() == b"3" and not list((tmp_path / "x").glob(".*.part"))


def test_manifest_entries_name_what_is_wrong():
    from ledgerloom.sources.snapshot import _ENTRY, entry

    good = {c.split()[0]: {"bigint": 7, "string": "", "boolean": True}[c.split()[1]] for c in _ENTRY.split(", ")} | {"end_hash": "a" * 64, "blob_digest": "b" * 64}
    assert entry(good)[0] == 7
    for change, name in (({"start_height": None}, "entry_type"), ({"blob_len": -1}, "entry_range"), ({"end_hash": "A" * 64}, "entry_digest"), ({"more": 1}, "entry_unknown_field"), ({"epoch_end": 1}, "entry_type")):
        with pytest.raises(IntegrityError, match=name):
            entry(good | change)
    with pytest.raises(IntegrityError, match="entry_missing_field"):
        entry({k: v for k, v in good.items() if k != "sapling"})


def test_no_blob_is_staged_and_no_block_is_put_in_order_again(spark, monkeypatch):
    """checked_ranges writes entries alone; store_install and store_reorganised write blocks where they are made."""
    from ledgerloom.plans import runtime
    from ledgerloom.queries import QUERIES

    staged, sealed, stage, write = [], [], runtime.stage, Store._write
    monkeypatch.setattr(runtime, "stage", lambda df, label: staged.append(label) or stage(df, label))

    def recorded(self, df, name, **options):
        sealed.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "sealed" else [])
        assert not options.get("by_range") or df.count() <= 2000  # the branch of a reorganisation, not the log
        return write(self, df, name, **options)

    monkeypatch.setattr(Store, "_write", recorded)
    for name in ("checked_ranges", "store_install", "store_reorganised"):
        QUERIES[name](spark, "/root/testdata/sf0.01")
    assert staged == ["entries", "entries"] and len(sealed) == 3
    assert "rangepartitioning" not in "".join(sealed) and "sha2(" in sealed[0]


def test_install_refuses_a_blob_that_changed_after_its_check(spark, tmp_path):
    files, entries = packed(spark, 0, 1999)
    checked = blobs.CheckedRanges.check(files, entries)
    checked.packed = files.withColumn("blob", F.when(F.col("start_height") == 1000, F.concat("blob", F.lit(b"x"))).otherwise(F.col("blob")))
    store = Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="blob_digest"):
        store.install(store.snapshot(), checked)
    checked.packed = files.where("start_height = 0")
    with pytest.raises(IntegrityError, match="continuity"):
        store.install(store.snapshot(), checked)
    assert store.snapshot().generation == 0


def test_dealt_batches_are_stored_like_others(spark, tmp_path):
    dealt = lambda df: df.withColumn("range_id", F.floor(F.col("height") / RANGE_SIZE)).repartition("range_id")
    one, two = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "two"))
    with pytest.raises(IntegrityError, match="range_id"):
        one.append(one.snapshot(), dealt(chain(spark, 0, 10)).withColumn("range_id", F.col("range_id") + 1))
    with pytest.raises(IntegrityError, match="continuity"):
        one.append(one.snapshot(), dealt(chain(spark, 0, 3000).withColumn("prev_hash", F.when(F.col("height") == 7, F.lit("f" * 64)).otherwise(F.col("prev_hash")))))
    s, t = one.snapshot(), two.snapshot()
    for low, high in ((0, 3209), (3210, 5300)):
        s, t = one.append(s, dealt(chain(spark, low, high))), two.append(t, chain(spark, low, high))
    s, t = (store.replace_deep(x, 1500, chain(spark, 1501, 4000, "b", 1500)) for store, x in ((one, s), (two, t)))
    rows = lambda x: sorted(x.blocks().collect(), key=lambda r: r.height)
    assert rows(s) == rows(t) and (s.tip, s.state["sealed_through"]) == (t.tip, t.state["sealed_through"]) == (4000, 2999)
    assert sorted(s.hash_index.collect()) == sorted(t.hash_index.collect()) and s.sealed.count() == t.sealed.count() == 3000
