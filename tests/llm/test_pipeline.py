"""Each stage of the pipeline on what the one before it kept, against brute force, and the whole of it."""

import corpus_pipeline
import pytest

from ledgerloom.llm import toxicity
from ledgerloom.plans.runtime import stage
from tests.llm.helpers import WORD, components, jaccard_links, line_form, shingles
from tests.llm.test_texts import brute_targets


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
        kept.append(docs)
    return kept


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_return_documents(run):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    assert all(df.columns == run[0].columns for df in run[:-1])


def test_toxic_documents_go_and_others_stay(spark, run, sf_dir):
    scored = toxicity.score(run[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert rejected and rows(run[1]) == [r for r in rows(run[0]) if r[0] not in rejected]


def test_one_line_of_each_component_stays(run):
    before = {r.doc_id: r.text for r in run[1].collect()}
    after = {r.doc_id: r.text for r in run[2].collect()}
    forms = {(d, i): line_form(x) for d, t in before.items() for i, x in enumerate((t or "").split("\n")) if line_form(x)}
    names = sorted(set(forms.values()))
    number = {f: k for k, f in enumerate(names)}
    grams = {number[f]: ({f[i : i + 8] for i in range(len(f) - 7)} or {f}) for f in names}
    group = components(range(len(names)), jaccard_links(grams, 4, 5))
    first = {}
    for place, f in sorted(forms.items()):
        first.setdefault(group[number[f]], place)
    for d, t in before.items():
        kept = [x for i, x in enumerate((t or "").split("\n")) if (d, i) not in forms or first[group[number[forms[d, i]]]] == (d, i)]
        assert after[d] == (None if t is None else "\n".join(kept))


def test_one_document_of_each_group_stays(run):
    before = {r.doc_id: r.text for r in run[2].collect()}
    sets = {d: shingles(t, 5) for d, t in before.items()}
    group = components(sets, jaccard_links({d: s for d, s in sets.items() if s}, 80, 100))
    assert sorted(r.doc_id for r in run[3].collect()) == sorted(d for d in sets if group[d] == d)


def test_sources_come_near_their_targets(run):
    size = lambda t: len(WORD.findall(t or ""))
    before, taken = {}, {}
    for r in run[3].collect():
        before[r.source] = before.get(r.source, 0) + size(r.text)
    for r in run[4].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    longest = max(size(r.text) for r in run[3].collect())
    goal = brute_targets(before)
    assert all(abs(taken.get(s, 0) - goal[s]) <= longest for s in before)


def test_everything_is_packed(run, spark, sf_dir):
    pieces = run[5].collect()
    documents = [r.doc_id for r in run[4].collect()]
    assert sorted(r.doc_id for r in pieces if r.start == 0) == sorted(documents)
    held = {}
    for r in pieces:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert max(held.values()) <= 2048 and len(held) <= 1.02 * sum(held.values()) / 2048 + 1
    assert rows(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(run[5].select("doc_id", "piece", "start", "length", "ids_crc32"))
