import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import kernels, linededup
from ledgerloom.llm.components import union_find
from tests.llm.helpers import WORD, components, line_form, lower, shingles

TEXT = st.text(st.sampled_from("abcAB \t\nxyé漢\x0b.1\x00"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(8, 64))
def test_words_are_those_of_the_pattern(texts, block):
    column = pa.array(texts, pa.string())
    body, starts, ends = kernels.string_buffers(column)
    usual, kernels.BLOCK = kernels.BLOCK, block
    try:
        h, r = kernels.words(body, starts, ends)
    finally:
        kernels.BLOCK = usual
    expected = [(k, w) for k, t in enumerate(texts) for w in WORD.findall(lower(t or ""))]
    assert r.tolist() == [k for k, _ in expected]
    same = {}
    for x, (_, w) in zip(h.tolist(), expected, strict=True):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 5))
def test_shingle_sets_have_the_right_sizes(texts, width):
    body, starts, ends = kernels.string_buffers(pa.array(texts))
    h, r = kernels.words(body, starts, ends)
    s, r = kernels.shingles(h, r, width, len(texts))
    values, at = kernels.distinct_sorted(s, r, len(texts))
    assert np.diff(at).tolist() == [len(shingles(t, width)) for t in texts]
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert (np.diff(values[a:b].astype(object)) > 0).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=8))
def test_lines_are_in_normal_form(texts):
    body, starts, ends = kernels.string_buffers(pa.array(texts, pa.string()))
    row, number, h1, h2, values, of, a, b = linededup.lines(body, starts, ends)
    expected = [(k, i, line_form(line)) for k, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if line_form(line)]
    assert list(zip(row.tolist(), number.tolist(), strict=True)) == [(k, i) for k, i, _ in expected]
    same = {}
    for x, y, (_, _, form) in zip(h1.tolist(), h2.tolist(), expected, strict=True):
        assert same.setdefault(form, (x, y)) == (x, y)
    assert len(set(same.values())) == len(same)
    for k, (_, _, form) in enumerate(expected):
        grams = {form[i : i + linededup.CHARS] for i in range(len(form) - linededup.CHARS + 1)} or {form}
        assert len(set(values[of == k].tolist())) == len(grams)
        assert line_form(bytes(body[a[k] : b[k]]).decode()) == form


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=900), st.sets(st.integers(0, 2**64 - 1), max_size=40))
def test_sketches_never_overstate_a_difference(a, flip):
    from ledgerloom.llm.linkage import sketch_distance

    b = a ^ flip
    sketch = lambda s: kernels.parity_sketch(np.array(sorted(s), np.uint64))
    assert sketch_distance(sketch(a), sketch(b)) <= len(flip)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_union_find(edges):
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    nodes, roots = union_find(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == components(set(a) | set(b), edges)
