"""Edge cases of the log operators, on rows made for them."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.errors import InvalidArgument, OutOfRange, ResourceExhausted, Unavailable
from ledgerloom.functions import scalars
from ledgerloom.operators import address, mempool, project, reads, stats, tiers, verify, windows
from ledgerloom.schema import SHIELDED, VTX


def chain(spark, heights, branch=""):
    rows = [(h, f"{branch}{h}", f"{branch}{h - 1}" if h else "genesis") for h in heights]
    return spark.createDataFrame(rows, "height bigint, hash string, prev_hash string")


def txs(spark, rows):
    return spark.createDataFrame(rows, f"height bigint, vtx {VTX}, sapling_size bigint, orchard_size bigint, ironwood_size bigint")


def tx(index, spends=0, outputs=0, actions=0, ironwood=0):
    act = lambda k, n: [(f"{k}n{i}", f"{k}c{i}") for i in range(n)]
    return (index, f"tx{index}", [(f"s{i}",) for i in range(spends)], [(f"o{i}",) for i in range(outputs)], act("a", actions), act("i", ironwood))


def values(df):
    return sorted(map(tuple, df.collect()))


def test_bounds_refuse_the_whole_request():
    reads.check_bounds(5, 1, 10)
    for start, end, error in ((None, 1, InvalidArgument), (1, 11, OutOfRange), (-1, 3, InvalidArgument)):
        with pytest.raises(error):
            reads.check_bounds(start, end, 10)
    with pytest.raises(Unavailable):
        reads.check_bounds(0, 0, None)
    with pytest.raises(Unavailable):
        reads.check_bounds(0, 10, 10, fresh=False, durable_tip=5)
    reads.check_bounds(0, 5, 10, fresh=False, durable_tip=5)


def test_lookup_prefers_the_hash(spark):
    blocks = chain(spark, range(3))
    with pytest.raises(InvalidArgument):
        reads.lookup(blocks, 1, "short")
    with pytest.raises(InvalidArgument):
        reads.lookup(blocks)
    assert reads.lookup(blocks, 1, "f" * 64).count() == 0
    assert reads.tip(blocks.where("height < 0")).count() == 0


def test_scan_runs_in_both_directions(spark):
    blocks = chain(spark, range(995, 1006))
    assert [r.height for r in reads.scan(blocks, 1002, 998).collect()] == [1002, 1001, 1000, 999, 998]
    assert [r.height for r in reads.scan(blocks, 998, 1002).collect()] == [998, 999, 1000, 1001, 1002]


@pytest.mark.parametrize("pools", [p for n in range(4) for p in itertools.combinations(SHIELDED, n)])
def test_pool_projection_of_every_subset(spark, pools):
    rows = [tx(k, *counts) for k, counts in enumerate(itertools.product((0, 2), repeat=4))]
    found = project.by_pool(txs(spark, [(7, rows, 13, 14, 15)]), pools).first()
    chosen = set(pools or SHIELDED)
    expected = []
    for t in rows:
        lists = (t[2] if "sapling" in chosen else [], t[3] if "sapling" in chosen else [], t[4] if "orchard" in chosen else [], t[5] if "ironwood" in chosen else [])
        if any(lists):
            expected.append((t[0], *map(len, lists)))
    assert [(t["index"], len(t.spends), len(t.outputs), len(t.actions), len(t.ironwood_actions)) for t in found.vtx] == expected
    assert (found.sapling_size, found.orchard_size, found.ironwood_size) == (13, 14, 15)


def test_pools_by_name():
    assert project.select_pools([]) == SHIELDED
    assert project.select_pools(["transparent"]) == ("transparent",)
    with pytest.raises(InvalidArgument):
        project.select_pools(["sprout"])


def test_transparent_alone_keeps_no_shielded_transaction(spark):
    assert project.by_pool(txs(spark, [(1, [tx(0, 1, 1, 1, 1)], 0, 0, 0)]), ["transparent"]).first().vtx == []


def test_nullifiers_keep_empty_transactions(spark):
    found = project.nullifiers(txs(spark, [(1, [tx(0), tx(1, 1, 1, 1, 1)], 3, 4, 5)])).first()
    assert [len(t.spends) for t in found.vtx] == [0, 1]
    assert found.vtx[1].outputs == [] and found.vtx[1].actions[0].nullifier == "an0" and found.vtx[1].actions[0].cmx == ""
    assert (found.sapling_size, found.orchard_size, found.ironwood_size) == (0, 0, 0)


def test_additions_and_size_bound(spark):
    row = txs(spark, [(1, [tx(0, 1, 2, 3, 4), tx(1, 0, 1, 0, 0)], 0, 0, 0)])
    counts = row.select(*[c.alias(p) for p, c in project.additions(F.col("vtx")).items()], project.encoded_size_bound(F.col("vtx")).alias("b")).first()
    assert tuple(counts) == (3, 3, 4, 192 + 2 * 64 + 36 + 3 * 128 + 7 * 160)


def test_transparent_merge_drops_empty_sides_and_null_points(spark):
    shielded = spark.createDataFrame([(1, 0, "a"), (1, 2, "b")], "height bigint, index bigint, x string")
    t = spark.createDataFrame(
        [(1, 0, [("p", 0)], []), (1, 1, [], [(5,)]), (1, 3, [(None, None)], []), (1, 4, [], [])],
        "height bigint, index bigint, vin array<struct<prevout_txid: string, prevout_index: bigint>>, vout array<struct<value: bigint>>",
    )
    found = {r["index"]: (r.x, r.vin, r.vout) for r in project.add_transparent(shielded, t).collect()}
    assert sorted(found) == [0, 1, 2] and found[2] == ("b", None, None) and len(found[0][1]) == 1


def test_running_sums_over_ranges_and_gaps(spark):
    rng = random.Random(3)
    rows = [(h, rng.randrange(9)) for h in range(4300) if h % 613]
    found = windows.running_sums(spark.createDataFrame(rows, "height bigint, n bigint"), {"n": "total"}, size=10)
    total, expected = 0, []
    for h, n in rows:
        total += n
        expected.append((h, total))
    assert values(found.select("height", "total")) == expected


def test_links_inside_and_across_ranges(spark):
    heights = [h for h in range(0, 2500) if h not in (700, 1999)]
    bad = chain(spark, heights).withColumn("hash", F.when(F.col("height").isin(42, 999), "x").otherwise(F.col("hash")))
    assert values(windows.broken_links(bad)) == [(43, "link"), (701, "height"), (1000, "link"), (2000, "height")]
    assert values(reads.breaks(bad).select("height")) == [(43,), (701,), (1000,), (2000,)]
    assert windows.broken_links(chain(spark, range(500, 1500))).count() == 0


def test_contiguous_prefix_cases(spark):
    heights = lambda hs: spark.createDataFrame([(h,) for h in hs], "height bigint")
    assert values(windows.contiguous_prefix(heights([0, 1, 2, 4, 5]))) == [(0,), (1,), (2,)]
    assert values(windows.contiguous_prefix(heights([1, 2]))) == []
    assert values(windows.contiguous_prefix(heights([]))) == []
    assert values(windows.contiguous_prefix(heights([3, 4, 9]), 3)) == [(3,), (4,)]


def test_linked_prefix_stops_at_the_first_break(spark):
    known, offered = chain(spark, range(5)).select("height", "hash"), chain(spark, range(5, 12))
    broken = offered.withColumn("prev_hash", F.when(F.col("height") == 8, "?").otherwise(F.col("prev_hash")))
    assert values(windows.linked_prefix(known, broken).select("height")) == [(5,), (6,), (7,)]
    assert windows.linked_prefix(known, offered).count() == 7
    assert windows.linked_prefix(known.where("height < 4"), offered).count() == 0


@pytest.mark.parametrize(("old", "new", "fork", "expected"), [(20, 30, 10, 10), (20, 15, 15, 15), (20, 15, 14, 14), (20, 20, None, None), (20, 20, 20, 20)])
def test_common_ancestor(spark, old, new, fork, expected):
    a = chain(spark, range(old + 1)).select("height", "hash")
    at = -1 if fork is None else fork
    b = chain(spark, range(new + 1)).select("height", F.when(F.col("height") <= at, F.col("hash")).otherwise(F.concat(F.lit("b"), "hash")).alias("hash"))
    ancestor = windows.common_ancestor(a, b)
    assert ancestor.first().ancestor == expected
    if expected is not None:
        rebuilt = windows.replace_suffix(a, ancestor, b)
        assert values(rebuilt) == values(b)
        assert values(windows.replace_suffix(a, ancestor, b.where("false")).select("height")) == [(h,) for h in range(expected + 1)]


def greedy(weights, most_rows, most_weight):
    out, g, n, w = [], 0, 0, 0
    for k, x in enumerate(weights):
        n, w = n + 1, w + x
        full = n >= most_rows or w >= most_weight
        out.append((k, g, full, full or k == len(weights) - 1))
        if full:
            g, n, w = g + 1, 0, 0
    return out


@pytest.mark.parametrize("weights", [[1] * 10, [1] * 11, [5, 5, 100, 1], [100], [], [0] * 3])
def test_greedy_groups(spark, weights):
    rows = spark.createDataFrame(list(enumerate(weights)), "start_height bigint, w bigint")
    found = windows.greedy_groups(rows, "start_height", "w", 10, 100)
    assert values(found.select("start_height", "group", "by_rule", "ends")) == greedy(weights, 10, 100)


@pytest.mark.parametrize(("height", "expected"), [(-1, [0, 1000]), (999, [1000]), (1999, [2000, 3000, 4000]), (2999, [3000, 4000]), (3500, []), (4999, [5000]), (5999, [])])
def test_part_of_an_epoch(spark, height, expected):
    groups = spark.createDataFrame([(k * 1000, g) for k, g in enumerate((0, 0, 1, 1, 1, 2))], "start_height bigint, group bigint")
    assert [r.start_height for r in verify.epoch_part_after(groups, height).orderBy("start_height").collect()] == expected


def test_greedy_groups_of_many_lists(spark):
    rng = random.Random(4)
    lists = {name: [rng.randrange(60) for _ in range(rng.randrange(1, 400))] for name in ("a", "b", None, "", "é")}
    rows = [(name, k, w) for name, weights in lists.items() for k, w in enumerate(weights)]
    rng.shuffle(rows)
    found = windows.greedy_groups(spark.createDataFrame(rows, "name string, k int, w int").repartition(5), "k", "w", 10, 100, "name")
    assert sorted(map(tuple, found.select("name", "k", "group", "by_rule", "ends").collect()), key=repr) == sorted(((name, *r) for name, weights in lists.items() for r in greedy(weights, 10, 100)), key=repr)


def test_subtree_spans_skip_empty_and_cross_many(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 3, 4), (3, 4, 17), (4, 17, 17)], "height bigint, a bigint, b bigint")
    assert values(windows.subtree_spans(rows, "a", "b", 4).select("height", "subtree")) == [(2, 0), (3, 1), (3, 2), (3, 3)]


@pytest.mark.parametrize("tip", [0, 9, 10, 98, 99, 100, 1098, 1099, 1100, 2098, 2099, 2209])
def test_tiers_use_exact_depths(tip):
    at = tiers.boundaries(tip)
    sealed = max([-1, *(e for e in range(999, tip + 1, 1000) if e <= tip - 100)])
    assert at == {"volatile": tip, "mutable": max(tip - 10, -1), "sealed": sealed}


def test_suffixes_against_every_pair(spark):
    rng = random.Random(5)
    ids = ["".join(rng.choice("ab") for _ in range(8)) for _ in range(40)]
    ids = sorted(set(ids))
    suffixes = [i[-k:] if k else "" for i in ids[:12] for k in range(9)] + ["zz", "b" * 66]
    expected = set()
    for s in set(suffixes):
        hits = [i for i in ids if i.endswith(s)] if len(s) <= 64 else []
        if len(hits) == 1:
            expected.add(hits[0])
    pool = spark.createDataFrame([(i,) for i in ids], "txid string")
    asked = spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    assert {r.txid for r in mempool.excluded(pool, asked).collect()} == expected
    alone = pool.limit(1)
    assert mempool.remaining(alone, spark.createDataFrame([("",)], "suffix string")).count() == 0


def test_addresses_limits_and_duplicates(spark):
    assert address.listed(["a", "b", "a"]) == ["a", "b"]
    with pytest.raises(InvalidArgument):
        address.listed(["a"] * 1001)
    names = spark.createDataFrame([(str(k % 3),) for k in range(9)], "address string")
    assert address.limited(names, 3).count() == 3
    with pytest.raises(ResourceExhausted):
        address.limited(names, 2)
    unspent = spark.createDataFrame([("0", 5), ("0", 6), ("9", 7)], "address string, value bigint")
    assert address.balance(unspent, names).first().balance == 11
    assert values(address.balances(unspent, names)) == [("0", 11), ("1", 0), ("2", 0)]
    huge = spark.createDataFrame([("0", 2**63 - 1), ("0", 1)], "address string, value bigint")
    with pytest.raises(PySparkException):
        address.balance(huge, names).collect()


def test_missing_transaction_of_a_history_is_an_error(spark):
    mined = spark.createDataFrame([("a",)], "txid string")
    history = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "height bigint, tx_index bigint, txid string")
    assert address.transactions(history.where("txid = 'a'"), mined).count() == 1
    with pytest.raises(PySparkException):
        address.transactions(history, mined).collect()


def test_manifest_rules(spark):
    cols = "start_height bigint, end_height bigint, sapling bigint, orchard bigint, ironwood bigint, sapling_frontier string, orchard_frontier string, ironwood_frontier string, epoch_end boolean"
    good = [(0, 999, 1, 0, 0, "f", "", "", False), (1000, 1999, 5, 2, 0, "f", "g", "", True)]
    assert verify.manifest_violations(spark.createDataFrame(good, cols), 1999).count() == 0
    assert values(verify.manifest_violations(spark.createDataFrame(good, cols), 999)) == [(1000, "sealed through")]
    bad = [(0, 999, 1, 0, 0, "f", "", "", True), (2000, 2999, 5, 2, 0, "f", "g", "", True), (3000, 3999, 4, 2, 0, "f", "g", "", False), (4000, 4999, 9, 2, 0, "", "g", "", False)]
    assert values(verify.manifest_violations(spark.createDataFrame(bad, cols), 4999)) == [(2000, "start"), (3000, "sizes fall"), (4000, "pool ends")]


def test_percentile_rules(spark):
    for n in (1, 4, 5, 20, 100, 101):
        rows = spark.createDataFrame([("k", float(v)) for v in random.Random(n).sample(range(n), n)], "k string, v double")
        near = stats.nearest_rank(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
        assert (near.p50, near.p95, near.p99) == tuple(float(-(-n * p // 100) - 1) for p in (50, 95, 99))
        floor = stats.floor_index(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
        assert (floor.p50, floor.p95) == (float(n // 2), float(int(0.95 * n)))


def test_next_sample_by_brute_force(spark):
    rng = random.Random(8)
    samples = sorted(rng.sample(range(300), 25))
    events = [rng.randrange(-20, 330) for _ in range(80)]
    found = stats.next_sample(spark.createDataFrame([(k, e) for k, e in enumerate(events)], "id int, t bigint"), spark.createDataFrame([(s, s * 10) for s in samples], "t bigint, v bigint"), "t", "v", 7)
    expected = [(k, e, next((s for s in samples if s >= e), samples[-1])) for k, e in enumerate(events)]
    assert values(found.select("id", "t", "next_time")) == expected
    assert all(r.next_value == r.next_time * 10 for r in found.collect())


def test_first_failure_takes_the_first_check_of_the_first_height(spark):
    rows = spark.createDataFrame([(0, 1, True, False), (0, 2, False, False), (1, 5, True, True)], "start_height bigint, height bigint, a boolean, b boolean")
    assert values(verify.first_failure(rows, {"a": F.col("a"), "b": F.col("b")})) == [(0, 1, "b")]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda *c: tuple(one.select(*c).first())
    assert get(scalars.display_order(F.lit("0102ff"))) == ("ff0201",)
    assert get(scalars.le_uint(F.unhex(F.lit("00010200")), 1, 2), scalars.be_uint(F.unhex(F.lit("00010200")), 1, 2)) == (513, 258)
    assert get(scalars.path_time(F.lit(86399))) == ("1970-01-01T235959Z",)
    texts = ["1970-01-01T235959Z", "1970-01-01 235959Z", "1970-02-30T000000Z", "x"]
    assert get(*[scalars.is_path_time(F.lit(t)).alias(str(k)) for k, t in enumerate(texts)]) == (True, False, False, False)
    assert get(scalars.checked_height(F.lit(2**32 - 1)), scalars.checked_height(F.lit(2**32))) == (2**32 - 1, None)
    assert get(scalars.metric_label(F.lit('x_total{a="1",b="2"} 3'), "b"), scalars.metric_label(F.lit("x 3"), "b")) == ("2", None)


def test_frames(spark):
    rows = [("a", 0, 1, True, "x"), ("a", 1, 1, False, "y"), ("b", 0, 1, True, "x"), ("c", 0, 1, True, "x"), ("c", 1, 2, False, "y"), ("d", 0, 1, True, "x"), ("d", 2, 1, False, "y")]
    found = tiers.frames(spark.createDataFrame(rows, "message string, place bigint, kind int, more boolean, body string"))
    assert values(found) == [("a", "xy", None), ("b", None, "no last frame"), ("c", None, "kind changes"), ("d", None, "frame missing")]
