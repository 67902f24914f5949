import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import kernels, linededup, linkage, mixing, ngramjoin, substring, toxicity, vecjoin
from ledgerloom.llm.components import components
from tests.llm.helpers import components as brute_components
from tests.llm.helpers import jaccard_links, line_form, shingles


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Originals of many lengths with copies that differ by a few words, chains of edits, a hot group of near copies."""
    rng = random.Random(seed)
    docs = []
    for n in (0, 1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 30, 45, 70, 100, 160, 250, 400, 900):
        base = words(rng, n)
        docs.append(base)
        for edits in (0, 1, 2, 4, 9):
            copy = list(base)
            for _ in range(min(edits, len(copy))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            docs.append(copy)
            docs.append(copy + words(rng, edits))
    step = words(rng, 120)
    for _ in range(12):  # each like the last one, the ends unlike
        step = list(step)
        step[rng.randrange(120)] = f"y{rng.randrange(999)}"
        docs.append(step)
    hot = words(rng, 150)
    for _ in range(90):
        copy = list(hot)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(150)] = f"z{rng.randrange(999)}"
        docs.append(copy)
    rng.shuffle(docs)
    glue = [" ", "  ", "\n", "\t "]
    return [(k, rng.choice(glue).join(d)) for k, d in enumerate(docs)] + [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \n ")]


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_finds_all_and_only_links(spark, width, num, den):
    rows = corpus()
    sets = {k: shingles(t, width) for k, t in rows}
    links = jaccard_links({k: s for k, s in sets.items() if s}, num, den)
    expected = brute_components(sets, links)
    found = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width=width, num=num, den=den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {k: (len(sets[k]), expected[k]) for k in sets}
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), width=width, num=num, den=den)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in sets if expected[k] == k)


def test_similar_pairs_share_a_signature():
    """Straight from the guarantee: whatever the differences, one signature is common."""
    rng = np.random.default_rng(4)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        for size in (5, 6, 8, 11, 14, 20, 33, 60, 150, 400):
            for _ in range(12):
                base = rng.integers(0, 2**64 - 1, size, dtype=np.uint64, endpoint=True)
                drop = rng.integers(0, max(1, size - num * size // den) + 1)
                a, b = set(base.tolist()), set(base[int(drop) :].tolist())
                while True:
                    more = b | {int(rng.integers(0, 2**63))}
                    if den * len(a & more) < num * len(a | more):
                        break
                    b = more
                if den * len(a & b) < num * len(a | b) or a == b:
                    continue
                signs = []
                for s in (a, b):
                    v = np.array(sorted(s), np.uint64)
                    signs.append(set(np.concatenate(ngramjoin.signatures(v, v * np.uint64(0x9E3779B97F4A7C15), num, den)).tolist()))
                assert signs[0] & signs[1], (num, size, len(a), len(b), len(a & b))


def test_ngram_join_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, key string, node int")
    assert ngramjoin.ngram_join(empty).collect() == []
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "q w e r t"), (7, "a B c d e"), (9, None)]
    found = ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, 2, None), (5, 2, None), (5, 2, None), (7, 2, None), (7, 2, None), (9, 0, 9)], key=repr)


@pytest.mark.parametrize("finish", [0, 5, 10**6])
def test_components_of_any_shape(spark, finish):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(200)]
    star = [(1000, k) for k in range(1001, 1100)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + loose + [(7, 7), (3, 2), (2, 3)]
    found = components(spark.createDataFrame([*edges, (None, 1), (1, None)], "a bigint, b bigint"), finish=finish)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert dict(map(tuple, found.collect())) == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a bigint, b bigint"), finish=finish).count() == 0


def _lines(rows):
    return {(d, i): line_form(x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if line_form(x)}


def line_corpus():
    rng = random.Random(6)
    alphabet = "abcdefghijklmnop "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).strip() or "q"
    base = [text(n) for n in (3, 8, 9, 20, 40, 60, 90, 150, 300, 700) for _ in range(3)]
    made = list(base)
    for b in base:
        for edits in (0, 1, 1, 2):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = "é"
            made.append("".join(c))
        made.append("  " + b.upper() + "\t")
    rng.shuffle(made)
    rows = [(k, "\n".join(made[k * 6 : k * 6 + 6])) for k in range(len(made) // 6)]
    return [*rows, (900, None), (901, ""), (902, "\n \n"), (903, base[4] + "\n\n" + base[5] + "\r\n")]


def test_lines_against_brute_force(spark):
    rows = line_corpus()
    forms = _lines(rows)
    names = sorted(set(forms.values()))
    grams = {f: ({f[i : i + 8] for i in range(len(f) - 7)} or {f}) for f in names}
    number = {f: k for k, f in enumerate(names)}
    links = jaccard_links({number[f]: g for f, g in grams.items()}, 4, 5)
    group = brute_components(range(len(names)), links)
    first = {}
    for place, f in sorted(forms.items()):
        first.setdefault(group[number[f]], place)
    expected = {p: first[group[number[f]]] for p, f in forms.items()}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc, r.line): (r.first_doc, r.first_line) for r in linededup.line_classes(df.repartition(3)).collect()}
    wrong = [p for p in expected if found.get(p) != expected[p]]
    assert set(found) == set(expected) and len(wrong) <= 0.01 * len(expected)  # banding finds nearly all
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    kept = {p for p in found if found[p] == p}
    for d, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in found or (d, i) in kept)
        assert texts[d] == left


def test_lines_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, gone int, n_chars bigint")
    assert linededup.dedup_lines(empty).collect() == []
    rows = [(None, "one line here\nx", "k", 1), (3, "one line here", "k", 2), (3, "one line here", "k", 2), (4, None, "k", 3)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string, mark string, n_chars bigint"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, "one line here\nx", "k", 15), (3, "", "k", 0), (3, "", "k", 0), (4, None, "k", None)], key=repr)


def buckets():
    """Rows (key, node, root, own, set) of buckets of several sizes."""
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (50, 60, 300, 2000)]
    rows = []
    for key, m in ((1, 2), (2, 70), (3, 1), (4, 200), (5, 9)):
        for _ in range(m):
            b = base[rng.integers(0, 4)]
            s = np.unique(np.concatenate([rng.permutation(b)[: len(b) - rng.integers(0, 6)], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
            rows.append((key, len(rows), int(rng.integers(0, 4)), bool(rng.integers(0, 2)), s))
    similar = set()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if x[0] == y[0] and x[2] != y[2] and (x[3] or y[3]):
                both = len(np.intersect1d(x[4], y[4]))
                if 5 * both >= 4 * (len(x[4]) + len(y[4]) - both):
                    similar.add((x[1], y[1]))
    return rows, similar


def cells(rows, parts, payload, name):
    """The rows at their cells as Arrow batches that cut cells anywhere, sorted as the shuffle leaves them."""
    out = []
    for key, node, root, own, s in rows:
        seat = node % parts
        out += [(key, min(seat, o), max(seat, o), seat, node, root, own, len(s), payload(s)) for o in range(parts)]
    out.sort(key=lambda r: r[:3])
    names = ["key", "a", "b", "seat", "node", "root", "own", "n", name]
    return [pa.record_batch([pa.array(c) for c in zip(*out[i : i + 37], strict=True)], names=names) for i in range(0, len(out), 37)]


@pytest.mark.parametrize("parts", [1, 3])
def test_buckets_lose_no_link_and_give_forests(parts):
    rows, similar = buckets()
    found = set()
    for out in linkage._survivors(4, 5)(iter(cells(rows, parts, kernels.parity_sketch, "sketch"))):
        found |= set(out.column("node").to_pylist())
    assert similar and {x for e in similar for x in e} <= found
    links = []
    for out in linkage._forest(4, 5, linkage.stored_sets)(iter(cells(rows, parts, lambda s: s.tobytes(), "feats"))):
        links += zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)
    assert set(links) <= similar and (parts > 1 or len(links) < len(rows))
    # with what hangs together already, the forest spans what all links span
    start = [(r[2], 1000 + r[1]) for r in rows]
    name = lambda links: [(1000 + a, 1000 + b) for a, b in links]
    nodes = [*range(4), *(1000 + r[1] for r in rows)]
    assert brute_components(nodes, start + name(links)) == brute_components(nodes, start + name(similar))


@pytest.mark.parametrize("seat", [4096, 50])
def test_a_large_group_of_near_copies(spark, monkeypatch, seat):
    """Thousands of copies of one text, some of which are only linked by a chain of others."""
    monkeypatch.setattr(linkage, "SEAT", seat)
    rng = random.Random(8)
    base = words(rng, 120, 5000)
    docs = []
    for k in range(1500 if seat > 1000 else 300):
        copy = list(base)
        for _ in range(rng.randrange(9)):  # about half as many edits keep two copies apart
            copy[rng.randrange(120)] = f"z{rng.randrange(9999)}"
        docs.append((k, " ".join(copy)))
    sets = {k: shingles(t, 4) for k, t in docs}
    expected = brute_components(sets, jaccard_links(sets, 85, 100))
    found = ngramjoin.ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in found.collect()} == expected
    assert len(set(expected.values())) > 5


def test_an_id_on_two_texts_of_equal_size_keeps_the_links_of_both(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(20):
        one = words(rng, 207, 9000)
        two = list(one)
        two[3] = "other"
        other = words(rng, 207, 9000)
        rows += [(k, " ".join(one)), (1000 + k, " ".join(two)), (1000 + k, " ".join(other))]
        pairs.append((1000 + k, k))
    found = {r.doc_id: r.component_id for r in ngramjoin.ngram_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(found[a] == b for a, b in pairs)


CLASHES = "_id int, _doc int, _mark int, _gone int, _times int, _copy int, node int, root int, key int, n int"


def test_helpers_take_any_column_names(spark):
    more = (1,) * 10
    rows = [(1, "one line here\nanother line there", "a", *more), (2, "one line here", "a", *more), (2, "one line here", "b", *more), (None, None, None, *more)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {CLASHES}")
    assert sorted(r.doc_id or 0 for r in ngramjoin.keep_one(docs).collect()) == [0, 1, 2, 2]
    assert {r.text for r in linededup.dedup_lines(docs).collect()} == {rows[0][1], "", None}
    assert substring.drop_repeats(docs).count() == 4
    assert set(mixing.copies(docs).columns) == set(docs.columns)
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    for kept in (toxicity.keep_clean(docs, labels), mixing.copies(docs), ngramjoin.keep_one(docs), linededup.dedup_lines(docs), substring.drop_repeats(docs)):
        assert kept.columns == docs.columns and kept.collect() is not None


def vectors(n_labels=3, per=150, size=12):
    rng = np.random.default_rng(3)
    rows = []
    for label in range(n_labels):
        x = rng.normal(size=(per, size))
        near = x[:40] + 0.03 * rng.normal(size=(40, size))
        hot = x[0] + 0.05 * rng.normal(size=(60, size))
        rows += [(v.tolist(), label) for v in np.concatenate([x, near, hot, x[:5], 7.5 * x[5:9]])]
    odd = [(None, 0), ([], 0), ([0.0] * size, 0), ([float("nan")] * size, 0), ([1.0] * (size - 1) + [float("inf")], 0), ([1.0, 2.0], 0), ([1.0, None] + [0.0] * (size - 2), 0), ([1.0] * size, None), ([1e-30] * size, 1), ([1e30] * size, 1)]
    rows += odd
    order = rng.permutation(len(rows))
    return [(int(k), rows[i][0], rows[i][1]) for k, i in enumerate(order)]


@pytest.mark.parametrize(("cell", "task", "others", "pivots"), [(2048, 2048, 8192, 65_536), (40, 40, 8192, 65_536), (40, 15, 30, 65_536), (40, 25, 60, 6), (2048, 50, 70, 9)])
def test_range_join_against_all_pairs(spark, monkeypatch, cell, task, others, pivots):
    for name, value in (("CELL", cell), ("TASK", task), ("OTHERS", others), ("PIVOTS", pivots)):
        monkeypatch.setattr(vecjoin, name, value)
    rows = vectors()
    unit = {}
    for k, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[k] = (label, len(v), x / np.linalg.norm(x))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.98]
    group = brute_components([r[0] for r in rows], links)
    count = {k: sum(k in e for e in links) for k, _, _ in rows}
    found = vecjoin.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4))
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == {k: (count[k], group[k], group[k] == k) for k in count}
    assert len(links) > 2000


def test_range_join_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vecjoin.near_duplicates(empty).collect() == []
    same = spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, vecjoin.near_duplicates(same.withColumn("node", F.lit("x"))).collect()), key=repr) == [(2, 2, None, False), (2, 2, None, False), (None, 2, None, True)]


@pytest.mark.parametrize("parts", [1, 7, 51])
def test_packed_slots_show_every_repeat(monkeypatch, parts):
    monkeypatch.setattr(linkage, "_SLOTS", 4000)
    rng = np.random.default_rng(5)
    low = np.uint64(64 - linkage._SLOT_BITS)
    keys = rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64, endpoint=True)
    keys = rng.permutation(np.concatenate([keys, keys[:300], np.repeat(keys[300:302], 900), np.array([0, 0, 2**64 - 1, 2**64 - 1], np.uint64)]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, len(keys) // 8).astype(np.int32)), pa.array(kernels.signed(keys)))
    batch = pa.record_batch([lists], names=["keys"])
    sent = list(linkage._pack(parts)(batch.slice(i, 1) for i in range(len(lists))))
    found = [x for out in linkage._repeated(parts)(iter(sent)) for x in out.column(0).to_pylist()]
    slots, times = np.unique(keys[: len(keys) // 8 * 8] >> low, return_counts=True)
    assert sorted(found) == slots[times > 1].tolist()
    assert list(linkage._pack(parts)(iter([]))) == [] == list(linkage._repeated(parts)(iter([])))


def test_rows_of_shared_keys_are_all_kept(spark):
    rng = random.Random(12)
    word = lambda: rng.randrange(-(2**63), 2**63)
    common = [word() for _ in range(200)]
    rows = [([word() for _ in range(9)] + rng.sample(common, k % 3), k, bool(k % 2)) for k in range(2000)] + [([], 2000, True)]
    rows += rows[:20]
    kept = [(r.key, r.node, r.own) for r in linkage.shared_rows(spark.createDataFrame(rows, "keys array<long>, node long, own boolean").repartition(5)).collect()]
    times = {}
    for keys, _, _ in rows:
        for x in keys:
            times[x] = times.get(x, 0) + 1
    given = [(x, node, own) for keys, node, own in rows for x in keys]
    assert sorted(x for x in kept if times[x[0]] > 1) == sorted(x for x in given if times[x[0]] > 1)
    assert len([x for x in kept if times[x[0]] == 1]) < 0.3 * len(given)


def shuffled(spark):
    """Bytes of shuffle files that each stage wrote, as far as the session remembers them."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_lines_that_stand_alone_shuffle_few_bytes(spark):
    rng = random.Random(13)
    rows = [(k, "\n".join(" ".join(words(rng, 8, 10**6)) for _ in range(50))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2).cache()
    docs.count()
    before = shuffled(spark)
    assert linededup.line_classes(docs).where("kept").count() == 6000
    docs.unpersist()
    sent = sum(n for k, n in shuffled(spark).items() if k > max(before))
    assert 0 < sent < 150 * 6000  # the 12 signatures of a line take some 40 of them


@pytest.mark.parametrize("bits", [27, 8, 6])
def test_copies_in_several_tasks_are_signed_once_at_least(spark, monkeypatch, bits):
    monkeypatch.setattr(linkage, "_MAP_BITS", bits)
    kept = []
    monkeypatch.setattr(linededup, "shared_rows", lambda candidates: kept.append(candidates.collect()) or linkage.shared_rows(candidates))
    rng = random.Random(14)
    hot = [" ".join(words(rng, 9, 10**6)) for _ in range(150)]
    near = [f"{x} more" for x in hot[:60]]
    rows = [(k, "\n".join(rng.sample(hot + near, 60) + [" ".join(words(rng, 9, 10**6)) for _ in range(6)])) for k in range(40)]
    found = linededup.line_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    forms = {(d, i): x for d, t in rows for i, x in enumerate(t.split("\n"))}
    first = {}
    for place, x in sorted(forms.items()):
        first.setdefault(x.removesuffix(" more"), place)
    assert {(r.doc, r.line): (r.first_doc, r.first_line) for r in found} == {p: first[x.removesuffix(" more")] for p, x in forms.items()}
    nodes = [r.node for r in kept[0]]
    assert len(set(nodes)) == len(set(forms.values()))
    if bits == 27:
        assert len(nodes) < 1.5 * len(set(nodes))  # over 3 times as many without the choice


def test_copies_in_many_tasks_shuffle_few_bytes(spark):
    rng = random.Random(15)
    text = "\n".join(" ".join(words(rng, 8, 10**6)) for _ in range(2000))
    docs = spark.createDataFrame([(k, text) for k in range(8)], "doc_id bigint, text string").repartition(8).cache()
    docs.count()
    before = shuffled(spark)
    assert linededup.line_classes(docs).where("kept").count() == 2000
    docs.unpersist()
    sent = sum(n for k, n in shuffled(spark).items() if k > max(before))
    assert 0 < sent < 100 * 16_000  # 142 bytes a line with the signatures of all copies, 60 without


def test_flagged_rows_miss_no_key(spark, monkeypatch):
    monkeypatch.setattr(linkage, "_MAP_BITS", 13)
    rows, keys = spark.range(-3000, 3000).toDF("x"), spark.range(0, 3000, 7).toDF("x")
    found = linkage.flagged(rows, keys, "x", "hit").collect()
    assert sorted(r.x for r in found) == list(range(-3000, 3000))
    assert {r.x for r in found if r.hit} >= set(range(0, 3000, 7)) and sum(r.hit for r in found) < 1500
    assert not any(r.hit for r in linkage.flagged(rows, keys.limit(0), "x", "hit").collect())
