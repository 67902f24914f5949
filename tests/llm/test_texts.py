import base64
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import annsearch, htmlx, mixing, packing, substring, toxicity, warc
from ledgerloom.llm.queries import tokenizer_files
from ledgerloom.plans.runtime import fresh_path
from tests.llm.helpers import WORD

# --- archives


def page_rows():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abc<é漢>\r\n0") for _ in range(n))
    rows = [(k, f"http://h/{k}", text(n)) for k, n in enumerate((0, 1, 7, 50, 700, 3000, 9000))]
    rows += [(7, "http://h/7", rows[3][2]), (8, None, rows[3][2]), (9, "http://h/9\r\nX: y", None), (10, "u", ""), (None, "u", rows[4][2]), (None, "u", "alone")]
    return [*rows, (8, None, rows[3][2])]


@pytest.mark.parametrize("least", [0, 20])
@pytest.mark.parametrize("segment", [64, 1000, 1 << 16])
def test_archives_give_back_what_went_in(spark, least, segment):
    rows = page_rows()
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), least, segment)
    expected = []
    newest = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None:
            newest[body] = max(newest.get(body, i), i)
    for i, _, html in rows:
        body = (html or "").encode()
        first = newest.get(body)
        revisit = len(body) >= least and first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expected.append((i, len(body), digest, "revisit" if revisit else "response", first if revisit else None, "ok"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_archive_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, digest int")
    assert warc.archive_round_trip(empty).collect() == []


def test_damaged_archives_are_named(spark):
    rows = [(1, "u", "x" * 500), (2, "u", "y" * 500), (3, "u", "".join(map(str, range(200)))), (4, "u", "w" * 500)]
    path = fresh_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path, segment=128)
    records = warc.read_records(spark, path).cache()
    of = {r.page_id: r.origin for r in records.where("page_id is not null").collect()}
    o, s = F.col("origin"), F.col("segment")
    broken = records.where(~((o == of[1]) & (s == 2))).withColumn("total", F.when(o == of[2], F.col("total") + 1).otherwise(F.col("total")))
    broken = broken.withColumn("block", F.when((o == of[3]) & (s == 3), F.reverse("block")).otherwise(F.col("block")))
    twice = broken.union(records.where((o == of[4]) & (s == 2)))
    status = {r.page_id: r.status for r in warc.reassemble(twice).collect()}
    assert status[1] == status[4] == "segments missing or repeated" and status[2] == "total length differs" and status[3] != "ok"
    assert records.where("kind = 'continuation'").count() > 8


def test_record_text_is_a_warc():
    records = list(warc.page_records(5, "http://h/", b"<p>" * 100, "k", None, False, segment=100))
    parsed = list(warc.parse_records(iter([b"".join(records)])))
    assert [h["warc-type"] for h, _ in parsed] == ["response"] + ["continuation"] * (len(parsed) - 1)
    block = b"".join(b for _, b in parsed)
    assert warc.payload_of(block) == (b"<p>" * 100, "ok") and int(parsed[-1][0]["warc-segment-total-length"]) == len(block)
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([b"".join(records)[:-9]])))
    for size in (1, 5, 1000):
        assert warc.dechunk(warc.chunked(b"a\r\n0\r\n\r\nb" * 20, size)) == b"a\r\n0\r\n\r\nb" * 20
    assert warc.dechunk(b"5\r\nabc") is None and warc.dechunk(b"x\r\n") is None and warc.dechunk(b"3;q=1\r\nabc\r\n0\r\nt: u\r\n\r\n") == b"abc"


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site {n}</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><script>var a="</p><p>no";</script>
{open}<h1>Title &amp; {n}</h1><p>First <b>bold</b>&nbsp;text\n  {n}<br>goes on<p>Second &lt;{n}&gt;<ul><li>one {n}<li>two</ul><form><input>Sign up</form><div class="ad">Buy</div>{close}
<aside>More</aside><div id="comments"><p>Nice!</p></div><footer>&copy; site</footer></body></html>"""


def expected_text(n):
    return f"Title & {n}\nFirst bold text {n} goes on\nSecond <{n}>\none {n}\ntwo"


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>")])
def test_article_without_its_surroundings(spark, tags):
    rows = [(n, f"http://Host:80/{n}", PAGE.format(n=n, open=tags[0], close=tags[1])) for n in range(12)]
    found = {r.page_id: r for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for n in range(12):
        text = found[n].text
        if tags[0].startswith("<div"):  # text that all pages of the host have is taken for the template's
            assert text == expected_text(n).replace("\ntwo", "") or text == expected_text(n)
        else:
            assert text == expected_text(n)
        assert found[n].n_chars == len(text)


def test_template_finds_the_article_where_no_tag_says_it(spark):
    page = "<body><div class=top><p>Welcome to us</p></div><div class=x><p>story {n} {t}</p><p>more {n}</p></div><div class=y><p>All rights</p></div></body>"
    rows = [(n, "http://a.b/", page.format(n=n, t="word " * n)) for n in range(9)] + [(100, "http://c/", page.format(n=1, t=""))]
    found = {r.page_id: r.text for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[n] == f"story {n} {'word ' * n}".strip() + f"\nmore {n}" for n in range(9))
    assert found[100] == "Welcome to us\nstory 1\nmore 1\nAll rights"  # one page tells nothing about its host


def test_an_article_tag_does_not_hide_the_other_slots(spark):
    page = "<body><div class=top><p>Welcome to us</p></div><article><p>teaser {n}</p></article><div class=x><p>story {n} {t}</p></div></body>"
    rows = [(n, f"http://a.b/{n}", page.format(n=n, t="word " * n)) for n in range(9)]
    found = {r.page_id: r.text for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[n] == f"teaser {n}\nstory {n} {'word ' * n}".strip() for n in range(9))


def test_paragraphs_may_vary_in_number(spark):
    page = "<body><div class=top><h1>title {n}</h1></div><div class=x>{body}</div></body>"
    lines = {n: [f"part {k} of {n}" for k in range(2 + n % 8)] for n in range(12)}
    rows = [(n, f"http://a.b/{n}", page.format(n=n, body="".join(f"<p>{x}</p>" for x in lines[n]))) for n in lines]
    found = {r.page_id: r.text for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[n] == "\n".join([f"title {n}", *lines[n]]) for n in lines)


def test_an_article_in_two_containers_is_kept_whole(spark):
    page = "<body><div class=top><p>Welcome to us</p></div><div class=lead><p>lead {n} {a}</p></div><div class=rest><p>rest {n} {b}</p></div></body>"
    rows = [(n, f"http://a.b/{n}", page.format(n=n, a="one " * 35, b="two " * 65)) for n in range(9)]
    found = {r.page_id: r.text for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[n] == f"lead {n} {'one ' * 35}".strip() + "\n" + f"rest {n} {'two ' * 65}".strip() for n in range(9))


def test_classes_out_of_order_are_no_part_of_the_template(spark):
    """Two boxes that swap places: one vector, but no order; what lies below them is judged by the slot around."""
    boxes = "<div class=a><p>one {n}</p></div>", "<div class=b><p>two {n}</p></div>"
    page = lambda n: f"<body><ul class=x>{''.join(boxes if n % 2 else boxes[::-1]).format(n=n)}</ul><div class=footer>f {n}</div></body>"
    df = spark.createDataFrame([(n, f"http://a.b/{n}", page(n)) for n in range(8)], "page_id bigint, url string, html string")
    (host,) = htmlx.templates(df).collect()
    assert {t.path for t in host.tokens} == {"", "/body", "/body/ul.x", "/body/ul.x/div.a/p", "/body/ul.x/div.b/p", "/body/div.footer!"}
    assert all(sorted(r.text.split("\n")) == [f"one {r.page_id}", f"two {r.page_id}"] for r in htmlx.extract(df).collect())


def test_templates_are_nested(spark):
    page = "<body><div class=nav><p>{n} x</p></div><div class=x><h2>t {n}</h2><p>story {n}</p></div></body>"
    df = spark.createDataFrame([(n, f"http://a.b/{n}", page.format(n=n)) for n in range(4)], "page_id bigint, url string, html string")
    (host,) = htmlx.templates(df).collect()
    path = {t.token: t.path for t in host.tokens}
    assert {(t.path, path.get(t.parent)) for t in host.tokens} == {
        ("", None), ("/body", ""), ("/body/div.nav!", "/body"), ("/body/div.nav!/p", "/body/div.nav!"), ("/body/div.x", "/body"),
        ("/body/div.x/h2", "/body/div.x"), ("/body/div.x/p", "/body/div.x"),
    }
    assert {t.path for t in host.tokens if t.dropped} == {"/body/div.nav!"}


def test_a_list_of_links_is_a_menu_by_the_template_alone(spark):
    page = "<body><div class=u><ul>{items}</ul></div><div class=x><h2><a href=1>t {n}</a></h2><p>story {n} <a href=2>more</a></p></div></body>"
    items = lambda n: "".join(f"<li><a href={k}>go {n} {k}</a></li>" for k in range(4 + n % 3))
    rows = [(n, f"http://a.b/{n}", page.format(n=n, items=items(n))) for n in range(7)]
    found = {r.page_id: r.text for r in htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(found[n] == f"t {n}\nstory {n} more" for n in range(7))
    assert all("go" in htmlx.main_text(h) for _, _, h in rows)  # without the template nothing tells them apart


def test_deep_paths_stay_apart():
    page = "".join(f"<div class=c{k}>" for k in range(300)) + "<p>x</p>" + "<div class=nav><p>y</p></div>"
    paths, _, above = htmlx.parse(page)
    assert len(set(paths)) == 304 and max(map(len, paths)) < 2 * htmlx.PATH and all(p == "" or p in above for p in paths)


def test_pages_of_the_driver_against_an_independent_extractor(spark):
    """The articles of the given pages, read by a few substitutions; and each host's text depends on its template."""
    import html
    import re

    def slow(page):
        inside = re.search(r"<article>(.*)</article>", page or "", re.S)
        body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", inside[1] if inside else "", flags=re.S)
        parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|li|section|blockquote|pre|table|tr|td)\b[^>]*>", body)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts)
        return "\n".join(x for x in lines if x)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in htmlx.extract(pages).collect()}
    rows = pages.collect()
    assert all(found[r.page_id] == slow(r.html) for r in rows)
    assert all(found[r.page_id] != htmlx.main_text(r.html) for r in rows if slow(r.html))


def test_templates_do_not_depend_on_partitions(spark):
    rows = [(n, "http://a.b/", PAGE.format(n=n, open="<div>", close="</div>")) for n in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    key = lambda d: sorted((r.host, sorted((t.path, t.text, t.token) for t in r.tokens)) for r in htmlx.templates(d).collect())
    assert key(df.coalesce(1)) == key(df.repartition(7))


def test_odd_pages(spark):
    pages = [None, "", "plain", "<p", "<p>a</p", "<article>a<article>b</article>c", "</div></p>x", "<!-- open", "<script>x", "<p>a" + "<div>" * 3000 + "z", "<a href='x>y'>q</a>", "&#x41;&bogus;&#0;"]
    rows = [(k, u, p) for k, p in enumerate(pages) for u in (None, "::", "http://[bad")]
    found = htmlx.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and texts[0] == texts[1] == "" and texts[2] == "plain" and texts[5] == "a\nb\nc" and texts[10] == "q"
    assert htmlx.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


# --- packing


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    rng = random.Random(3)
    texts = [None, "", "a", "x" * 5000, "é漢 <|endoftext|> \x85   z", "tab\tand\n\n new  line 123's"] + [" ".join(rng.choice(["alpha", "Beta,", "99", "naïve"]) for _ in range(n)) for n in rng.choices(range(1, 400), k=300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "b c")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), capacity=128, **files).collect()
    import zlib

    slow = Tokenizer.from_file(files["tokenizer"])
    expected = []
    for k, t in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        expected += [(k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted([tuple(r)[:5] for r in found], key=repr) == sorted(expected, key=repr)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= 1.02 * sum(r.length for r in found) / 128 + 1


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string, task int"), **tokenizer_files()).collect() == []


@pytest.mark.parametrize("kind", ["docs", "thirds", "big", "one", "none"])
def test_plans_place_every_piece_and_stay_near_the_bound(kind):
    rng = np.random.default_rng(2)
    lengths = {
        "docs": np.minimum(2048, rng.exponential(700, 60_000).astype(int) + 5), "thirds": rng.integers(600, 760, 60_000),
        "big": rng.integers(1025, 2048, 40_000), "one": np.full(70_000, 500), "none": np.zeros(0, int),
    }[kind]
    h = np.bincount(lengths, minlength=2049)
    plan = packing.configurations(h, 2048)
    used = np.zeros(2049, int)
    for pattern, n in plan:
        assert sum(pattern) <= 2048
        np.add.at(used, list(pattern), n)
    assert (used == h).all()
    bound = {"docs": h @ np.arange(2049) / 2048, "thirds": h @ np.arange(2049) / 2048, "big": h.sum(), "one": len(lengths) / 4, "none": 0}[kind]
    assert sum(n for _, n in plan) <= 1.02 * bound + 1


@pytest.mark.parametrize("times", [1, 100])
@pytest.mark.parametrize("pieces", [3, 40, 1_000, 20_000])
def test_the_program_runs_at_every_size_and_leaves_a_bounded_rest(monkeypatch, pieces, times):
    rng = np.random.default_rng(3)
    h = np.bincount(np.minimum(2047, rng.exponential(500, pieces).astype(int) + 1), minlength=2049) * times
    rests, real = [], packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda left, capacity: rests.append(int(left.sum())) or real(left, capacity))
    plan = packing.configurations(h, 2048)
    assert rests[0] <= min(np.count_nonzero(h), h.sum() // 2)
    assert sum(n * len(p) for p, n in plan) == h.sum()
    assert pieces < 1_000 or sum(n for _, n in plan) <= 1.03 * (h @ np.arange(2049)) / 2048 + 1


def test_best_fit_of_many_alike_pieces():
    h = np.zeros(101, int)
    h[[60, 40, 30, 7, 100]] = [10**12, 10**12 + 5, 9, 10**9, 4]
    plan = packing.best_fit(h, 100)
    used = np.zeros(101, int)
    for pattern, n in plan.items():
        assert sum(pattern) <= 100
        np.add.at(used, list(pattern), n)
    assert (used == h).all() and len(plan) < 20 and sum(plan.values()) <= (h @ np.arange(101)) / 100 * 1.01


# --- toxicity


def toxic_corpus(n=1200):
    rng = random.Random(9)
    plain = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}{k}" .rstrip("0123456789") + rng.choice("tpk") for k in range(400)]
    insults = ["idiot", "blarg", "blargen", "scum", "zzoxa", "zzoxo", "zzoxum", "worthless"]
    rows, labels = [], []
    for k in range(n):
        toxic = rng.random() < 0.15
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if toxic:
            for w in rng.choices(insults, k=rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words) + "."))
        if rng.random() < 0.6:
            labels.append((k, int(toxic), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    import zlib

    rows, labels = toxic_corpus()
    found = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {k: t for k, _, t in labels}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(found) == len(rows) and right >= 0.97 * len(held) and sum(truth[r.doc_id] for r in held) > 5
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_change_nothing(spark):
    import zlib

    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    a, b = (sorted(map(tuple, toxicity.score(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = [(1, "you idiot scum moron"), (2, None), (3, ""), (None, "x"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = toxicity.score(docs, labels).collect()
    assert len(found) == 5 and all(r.held_out for r in found if r.doc_id is None)
    assert toxicity.score(docs.limit(0), labels).collect() == []
    assert toxicity.score(docs, labels.limit(0)).count() == 5


def test_label_model_recovers_rates_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(200_000) < 0.1
    hit, false = np.array([0.6, 0.5, 0.7, 0.4, 0.55, 0.5]), np.array([0.01, 0.02, 0.005, 0.01, 0.01, 0.01])
    votes = np.where(y[:, None], rng.random((len(y), 6)) < hit, rng.random((len(y), 6)) < false)
    votes = np.column_stack([votes, votes[:, 0] ^ (rng.random(len(y)) < 0.01)])  # a copy of the first voter
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, n, 0.12, 7)
    assert (0, 6) in model.correlated and model.weight[0] < 1
    assert np.abs(model.hit[:6] - hit).max() < 0.08 and np.abs(model.false[:6] - false).max() < 0.01


# --- nearest neighbours


def test_recall_and_order(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16)), np.repeat(centres[:1], 600, 0)]) * rng.uniform(0.5, 2, (2100, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = annsearch.search(df, df.where("vec_id % 20 = 0"), k=10).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, 2100, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:10]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in mine)
        hits += sum(r.score >= s[best[-1]] - 1e-9 for r in mine)
    assert hits >= 0.9 * 10 * len(got) and len(got) == 105


def test_recall_of_the_query_outside_its_calibration(spark, monkeypatch):
    """The registered query on the driver's vectors against all rows, leaves and queries in several parts."""
    import ledgerloom.llm.queries as registered

    monkeypatch.setattr(annsearch, "TASK", 300)
    monkeypatch.setattr(annsearch, "ASKED", 20)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    found = {}
    for r in registered.op6_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    queries = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[queries].tolist())
    shares = []
    for q in queries:
        scores = x @ x[q]
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        assert len(found[ids[q]]) == 20
        shares.append(len(set(best.tolist()) & set(found[ids[q]])) / 20)
    spared = spark.createDataFrame([(int(i),) for i in ids[queries]], "id long").orderBy(F.xxhash64("id"), "id").limit(min(annsearch.CALIBRATION, -(-len(queries) // 2))).collect()
    inside = np.isin(ids[queries], [r.id for r in spared])
    assert np.mean(np.array(shares)[~inside]) >= 0.95


def test_queries_go_on_until_they_have_enough(spark):
    """A leaf of its own for the query alone: its neighbours are in others."""
    rng = np.random.default_rng(2)
    tree = annsearch.fit_tree(np.concatenate([rng.normal(size=(400, 4)), 50 + rng.normal(size=(400, 4))]), 8)
    rows = np.zeros(len(tree.leaves), np.int64)
    rows[3] = 5
    (mine,) = tree.visits(rng.normal(size=(1, 4)), 1, rows, 5)
    assert 3 in mine.tolist() and tree.visits(rng.normal(size=(2, 4)), 2, rows, 0).shape == (2, 2)


def test_few_or_no_candidates(spark):
    schema = "vec_id bigint, embedding array<float>, id string"
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (20, [0.0, 1.0], "b"), (3, [1.0, 1.0], "c")], schema)
    found = annsearch.search(df, df.where("vec_id % 20 = 0"), k=20)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert annsearch.search(df.limit(0), df.limit(0)).collect() == []
    one = df.where("vec_id = 0")
    assert annsearch.search(one, one).collect() == []


# --- passages


def test_shared_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(20)]
    rows = [(k, f"{text(rng.randrange(40, 300))} {shared[k % 20]} {text(rng.randrange(40, 300))}") for k in range(80)]
    rows += [(100 + k, text(200)) for k in range(40)] + [(200, None), (201, ""), (202, text(3000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.passages(df.repartition(3)).collect()
    hit = {r.doc_id for r in found}
    assert hit <= set(range(80)) and len(hit) >= 76
    body = dict(rows)
    for r in found:
        part = body[r.doc_id].encode()[r.start : r.start + r.length]
        where = body[r.doc_id].encode().find(shared[r.doc_id % 20].encode())
        assert part.strip() in shared[r.doc_id % 20].encode() and r.start >= where - 1
        assert r.first == (r.doc_id < 20)
    left = {r.doc_id: r.text for r in substring.drop_repeats(df).collect()}
    assert all(left[k] == body[k] for k in range(20)) and all(left[k] == body[k] for k in (*range(100, 140), 200, 201, 202))
    assert sum(len(left[k].encode()) < len(body[k].encode()) - 150 for k in range(20, 80)) >= 55


def brute_passages(rows):
    """The stretches covered by windows of 51 words that another document has too, in bytes."""
    places, seen = {}, {}
    for k, text in rows:
        body = (text or "").encode()
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", body)]
        places[k] = [(words[i][0], words[i + 50][1]) for i in range(len(words) - 50)]
        for a, b in places[k]:
            seen.setdefault(body[a:b], set()).add(k)
    found = set()
    for k, text in rows:
        body, runs = (text or "").encode(), []
        for a, b in places[k]:
            if len(seen[body[a:b]]) > 1:
                first = k == min(seen[body[a:b]])
                if runs and a <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], b, runs[-1][2] and first)
                else:
                    runs.append((a, b, first))
        found |= {(k, a, b - a, first) for a, b, first in runs}
    return found


@pytest.mark.parametrize("letters", [1, 2, 6])
def test_passages_of_51_words_however_short(spark, letters):
    rng = random.Random(letters)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, letters))) for _ in range(n))
    shared = [text(n) for n in (51, 51, 51, 52, 60, 130, 50, 49)]
    rows = [(k, f"{text(rng.randrange(0, 90))} {shared[k % 8]}\n{text(rng.randrange(0, 90))} {shared[rng.randrange(8)]}") for k in range(80)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, " ".join(["a"] * 300)), (103, " ".join(["a"] * 90))]
    found = substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.doc_id, r.start, r.length, r.first) for r in found} == brute_passages(rows)


def test_chunks_cover_the_text_and_survive_a_shift():
    rng = random.Random(1)
    data = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(3000)).encode()
    cuts = []
    for body in (data, b"some more " + data):
        part = np.frombuffer(body, np.uint8)
        row, a, b, at = substring.anchored(part, np.array([0]), np.array([len(part)]))
        assert a[0] == 0 and b[-1] == len(part) and (a[1:] < b[:-1]).all() and not row.any()
        assert all(len(body[i:j].split()) >= substring.WORDS for i, j in zip(a, b, strict=True))
        cuts.append({body[i:j] for i, j in zip(a, b, strict=True)})
    assert len(cuts[0] & cuts[1]) >= len(cuts[0]) - 2


def test_passages_among_rows_without_an_id(spark):
    shared = " ".join(f"w{k * k}" for k in range(80))
    rows = [(None, f"one {shared} a"), (None, f"two {shared} b"), (5, "nothing of that")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.passages(df).collect()
    assert [(r.doc_id, r.start, r.length) for r in found] == [(None, 4, len(shared))] * 2 and sorted(r.first for r in found) == [False, True]
    assert sorted(len(r.text.split()) for r in substring.drop_repeats(df).collect()) == [2, 3, 82]


def test_passages_of_odd_tables(spark):
    assert substring.passages(spark.createDataFrame([], "doc_id bigint, text string, run int")).collect() == []
    long = " ".join(f"word{k * k}" for k in range(80))
    rows = [(None, long), (None, long), (4, long)]
    found = substring.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in found} == {None, 4} and all(r.first == (r.doc_id is None) for r in found)


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 2 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(1500):
        source = rng.choice(["s1", "s2", "S9", "é", None] + ["hot"] * 4)
        rows.append((k, None if k % 97 == 0 else " \n".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), source))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(df).collect()
    size = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    per = {}
    for k, _, s in rows:
        per[s] = per.get(s, 0) + size[k]
    goal = brute_targets(per)
    of = {k: s for k, _, s in rows}
    taken = {}
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == per[of[r.doc_id]] and abs(r.target - goal[of[r.doc_id]]) < 1e-6
        assert r.size == r.taken == 0 or (r.taken % r.size == 0 and r.taken <= 2 * r.size)
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 100 for s in per)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()))
    copies = mixing.copies(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.taken // r.size for r in found if r.taken}


def test_mix_by_document_weight(spark):
    rows = [(k, "w " * 10, "a", float(k % 4)) for k in range(2000)] + [(5000 + k, "w " * 10, "b", None) for k in range(10)]
    found = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, q double"), weights=(1,), share=0.5, weight_col="q").collect()}
    mean = [np.mean([found[k] for k in range(q, 2000, 4)]) / 10 for q in range(4)]
    assert mean[0] == 0 and abs(mean[2] / mean[1] - 2) < 0.25 and abs(mean[3] / mean[1] - 3) < 0.35
    assert all(found[5000 + k] == 0 for k in range(10))


def test_mix_of_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string, rank int")).collect() == []
    none = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
    same = mixing.mix(spark.createDataFrame([(None, "a b", "x"), (None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")], "doc_id bigint, text string, source string")).collect()
    assert sum(r.taken for r in same) == 12 and len(same) == 4


def test_mixing_stays_in_the_engine(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "x")], "doc_id bigint, text string, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and json.dumps(plan)
