"""Near-duplicates against all pairs on full sets."""

import random
import re

import pytest

from tickframe.llm import common, near
from tickframe.llm.common import components, table

from .fixtures import odd_docs, rows


def brute(docs, k, percent):
    def cut(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()

    sets = [cut(d.text) for d in docs]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    live = [i for i, d in enumerate(docs) if d.doc_id is not None and sets[i]]
    at = {}
    for i in live:
        at.setdefault(next(iter(sorted(sets[i]))), [])
    for n, i in enumerate(live):
        for j in live[:n]:
            a, b = sets[i], sets[j]
            if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
                continue
            c = len(a & b)
            if 100 * c >= percent * (len(a) + len(b) - c):
                x, y = sorted((root(docs[i].doc_id), root(docs[j].doc_id)))
                up[y] = x
    return sorted(((d.doc_id, len(s), c := root(d.doc_id) if d.doc_id is not None and s else d.doc_id, d.doc_id is None or c == d.doc_id) for d, s in zip(docs, sets, strict=True)), key=repr)


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_components(spark, sf, kind, k):
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    assert rows(near.near_duplicates(docs, k)) == brute(docs.collect(), k, 80)


@pytest.mark.parametrize("sizes", [(4, 1000, 4), (4, 8, 2), (2, 3, 0)])
def test_large_nodes(spark, monkeypatch, sizes):
    """Groups of texts a few words apart, far more than a small node holds, and chains at the threshold."""
    for name, v in zip(("SMALL", "OUTSIDE", "MORE"), sizes, strict=True):
        monkeypatch.setattr(near, name, v)
    monkeypatch.setattr(near, "BLOCK_X", 5)
    monkeypatch.setattr(near, "BLOCK_Y", 7)
    rng = random.Random(5)
    word = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(4):
        base = [rng.choice(word) for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(1, 14)):
                own[rng.randrange(len(own))] = rng.choice(word)
            out.append(own)
    chain = [rng.choice(word) for _ in range(100)]
    for _ in range(20):
        chain = chain[5:] + [rng.choice(word) for _ in range(5)]
        out.append(chain)
    rng.shuffle(out)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(out)], "doc_id long, text string")
    assert rows(near.near_duplicates(docs, 2)) == brute(docs.collect(), 2, 80)


@pytest.mark.parametrize("edges_a_task", [1 << 20, 20])
def test_component_ids(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(common, "EDGES", edges_a_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {100: 90, 95: 90} | {201 + i: 200 for i in range(50)}
    assert {k: v for k, v in got.items() if k != v} == want


def test_odd_sketches_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 700, 1024, 1030, 5000, 40_000):
        for _ in range(20):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(n / 9)
            a, b = np.unique(base), np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)]))
            (la, ca, sa), (lb, cb, sb) = near.odd_sketch(a), near.odd_sketch(b)
            i, j = (0, 0) if la == lb else (0, 1) if la == lb + 1 else (1, 0)
            differ = (int.from_bytes(sa[i], 'big') ^ int.from_bytes(sb[j], 'big')).bit_count()
            most = (ca[i] + cb[j]) / 9
            assert differ <= most + (5 * most**0.5 if max(la, lb) else 0)


def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows(near.op3_near_duplicates(spark, sf)) == sorted(con.sql(near.OP3_SQL).fetchall(), key=repr)


@pytest.mark.parametrize("closest", [(4, 64, 2048), (1, 2048)])
def test_held_back_candidates_come_later(spark, monkeypatch, closest):
    """Sets whose closest candidates fail on full sets are held against the others in later rounds."""
    monkeypatch.setattr(near, "CLOSEST", closest)
    monkeypatch.setattr(near, "APART", -1)  # no links before the outsiders are compared
    monkeypatch.setattr(near, "SMALL", 2)
    rng = random.Random(8)
    word = [f"w{i}" for i in range(400)]
    base = [rng.choice(word) for _ in range(150)]
    out = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 22)):
            own[rng.randrange(len(own))] = rng.choice(word)
        out.append((k, " ".join(own)))
    docs = spark.createDataFrame(out, "doc_id long, text string")
    assert rows(near.near_duplicates(docs, 2)) == brute(docs.collect(), 2, 80)


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a text of its own", 1), (1, "and something else here", 2), (1, "a text of its own", 3), (2, "a text of its own", 4), (None, "x", 5), (None, "x", 6)], "doc_id long, text string, rank int")
    for _ in range(2):
        got = rows(near.one_of_each(docs, 2))
        assert [r[:2] for r in got] == [(1, "a text of its own"), (1, "and something else here"), (None, "x"), (None, "x")]
    assert near.one_of_each(docs, 2).columns == docs.columns and rows(near.one_of_each(docs, 2)) == got
