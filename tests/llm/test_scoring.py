"""Scores: base against plain Python, the model against the base on held-out documents, normalisation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickframe.llm import lbl, scoring
from tickframe.llm.common import table

from .fixtures import odd_docs


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


def brute(docs):
    out_ = [zlib.crc32(("" if d.doc_id is None else str(d.doc_id)).encode()) % 5 == 1 for d in docs]
    c = Counter(t for d, o in zip(docs, out_, strict=True) if not o for t in tokens(d.text))
    n, v = sum(c.values()), len(c)
    for d, o in zip(docs, out_, strict=True):
        t = tokens(d.text)
        yield (d.doc_id, o, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
@pytest.mark.parametrize("head", [65_536, 60])
def test_base(spark, sf, kind, head, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", head)
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    got = sorted((tuple(r) for r in scoring.score(docs).collect()), key=lambda r: (repr(r[0]), r[2]))
    want = sorted(brute(docs.collect()), key=lambda r: (repr(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(math.isfinite(r[6]) and r[6] <= 1e-9 for r in got)


def test_beats_the_base_on_held_out_documents(spark):
    got = [r for r in scoring.score(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.96 * sum(r.base_score for r in got)


def test_normalised_and_learns():
    rng = np.random.default_rng(0)
    ids = np.empty(60_000, np.int64)
    ids[0] = 0
    for i in range(1, len(ids)):
        ids[i] = (ids[i - 1] + 1) % 20 if rng.random() < 0.8 else rng.integers(20)
    starts = np.zeros(len(ids), bool)
    starts[0] = True
    m = lbl.Model(np.bincount(ids, minlength=20).astype(float))
    before = m.log10(ids[:5000], starts[:5000]).mean()
    m.table = None
    for _ in range(3):
        m.train(ids, starts)
    assert m.log10(ids[:5000], starts[:5000]).mean() > before + 0.3
    m.table = None
    total = sum(10 ** m.log10(np.array([3, 4, w]), np.array([True, False, False]))[2] for w in range(20))
    assert abs(total - 1) < 1e-4


def test_noise_draws_and_updates_per_token():
    """Every 1024 training tokens have an update and 64 noise draws of their own at least."""
    n = 10_240
    ids = np.random.default_rng(0).integers(0, 50, n)
    m = lbl.Model(np.bincount(ids, minlength=50).astype(float))
    drawn, rng = [], m.rng

    class Counting:
        permutation = staticmethod(rng.permutation)

        def random(self, size):
            drawn.append(size)
            return rng.random(size)

    m.rng = Counting()
    m.train(ids, np.arange(n) % 100 == 0)
    assert len(drawn) >= n // 1024 and sum(drawn) >= 64 * n // 1024
