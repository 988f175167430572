"""Base spans against the stated patterns, and the tagger's accuracy on held-out documents."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickframe.llm import personal
from tickframe.llm.common import table

from .fixtures import odd_docs, rows

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = k == 0 or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 3 and 9 <= len(d) <= 15)
            if k == 2 and 13 <= len(d) <= 19:
                ok = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+% 0123459()é\n", max_size=60))
def test_base_spans(text):
    assert personal.base_spans(text) == plain(text)


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_find(spark, sf, kind):
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    got = personal.find(docs, personal.train(docs, steps=30)).collect()
    want = []
    for d in docs.collect():
        spans = plain(d.text or "")
        want.append((d.doc_id, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(personal.joined(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert len(spans) == sum(r[1:5]) + r.n_added
        assert {f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in plain(texts[r.doc_id] or "")} <= {":".join(x) for x in spans}


def test_tagger_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = personal.train(docs.where("doc_id % 4 <> 0"))
    hits = miss = false = 0
    for d in docs.where("doc_id % 4 = 0").collect():
        base = {(k, a, b) for k, a, b in personal.base_spans(d.text)}
        got = set(personal.added([d.text], [[]], model)[0])
        hits, miss, false = hits + len(base & got), miss + len(base - got), false + len(got - base)
    assert hits >= 15 and hits / (hits + miss) > 0.85 and hits / (hits + false) > 0.85, (hits, miss, false)


def test_gradients():
    from tickframe.llm.tagger import Tagger, tags_of

    m = Tagger(3, 4)
    rng = np.random.default_rng(0)
    chars, tags = rng.integers(0, 99, (2, 9)), np.stack([tags_of([(1, 2, 5)], 9), tags_of([(0, 0, 3), (3, 4, 9)], 9)])

    def loss():
        e, _ = m.emissions(chars)
        z, *_ = m.forward_backward(e)
        gold = sum(float(e[t, r, tags[r, t]]) + float(m.w["T"][tags[r, t - 1], tags[r, t]] if t else m.w["S"][tags[r, 0]]) for r in range(2) for t in range(9))
        return (z.sum() - gold) / tags.size

    before, adam = loss(), {}
    for _ in range(40):
        m.step(chars, tags, adam, 0.02)
    assert loss() < 0.5 * before
