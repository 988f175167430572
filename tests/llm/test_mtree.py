"""Top-k against all inner products."""

import numpy as np
import pytest

from tickframe.llm import mtree
from tickframe.llm.common import table

from .fixtures import rows


def brute(data, k=10):
    live = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in live if i % 100 == 0}):
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in live if j != i and len(v) == len(q)))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def odd(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(400)]
    data += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]  # one very common vector
    data += [(1000, None), (1100, []), (1200, [1.0, None]), (1300, [float("nan"), 1.0]), (1400, [float("inf"), 1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    data += [(1500, [1.0, 2.0]), (1501, [3.0, -1.0]), (1502, [0.0, 0.0]), (200, data[200][1]), (1503, data[3][1]), (1503, data[3][1])]
    return spark.createDataFrame([(*d, 1, 2) for d in data], "vec_id long, embedding array<double>, score int, rank int")


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
@pytest.mark.parametrize("size", [(256, 16, 4096), (4, 3, 50)])
def test_top_k(spark, sf, kind, size, monkeypatch):
    for name, v in zip(("PAGE", "FAN", "TREE"), size, strict=True):
        monkeypatch.setattr(mtree, name, v)
    v = table(spark, sf, "embeddings") if kind == "table" else odd(spark)
    v = v.limit(0) if kind == "empty" else v
    got = rows(mtree.top_k(v, v.where("vec_id % 100 = 0")))
    assert got == brute([(r.vec_id, r.embedding) for r in v.collect()])


def test_pages_spare_computations(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.floor(1024 * (rng.normal(size=(40, 6))[rng.integers(40, size=4000)] + 0.02 * rng.normal(size=(4000, 6))))
    norm = float(np.sqrt((x**2).sum(1).max())) * (1 + 1e-9)
    monkeypatch.setattr(mtree, "PAGE", 64)
    tree = mtree.build(np.arange(4000), x, norm)
    total = 0
    for i in range(0, 4000, 200):
        got, computed = mtree.search(tree, x[i], i, 10, norm)
        s = x @ x[i]
        want = sorted((-s[j], j) for j in range(4000) if j != i)[:10]
        assert sorted((-a, b) for a, b in got) == want
        total += computed
    assert total < 0.5 * 20 * 4000


def test_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert rows(mtree.op4_top_k(spark, sf)) == sorted(con.sql(mtree.OP4_SQL).fetchall(), key=repr)
