"""The pipeline: each stage against plain Python on its own input, and the whole of it."""

from collections import Counter, defaultdict

import pytest
import zstandard

import corpus_pipeline
from tickframe.llm import quality
from tickframe.llm.common import stored, table

from .fixtures import odd_docs
from .test_counting import WORD, brute_mix, brute_quality
from .test_lines import brute as brute_lines
from .test_near import brute as brute_near


def brute_kept(text):
    """The quality verdict by the stated bands."""
    if not text or brute_quality(text)[-1]:
        return False
    b, c = text.encode(), zstandard.ZstdCompressor(level=3)
    _, low, high, chunk_low, chunk_high = next(x for x in quality.BANDS if len(b) <= x[0])
    rates = [len(c.compress(p)) / len(p) for p in (b[i : i + 1024] for i in range(0, len(b), 1024)) if len(p) >= 512]
    return low <= len(c.compress(b)) / len(b) <= high and all(chunk_low <= r <= chunk_high for r in rates)


@pytest.mark.parametrize("kind", ["table", "odd", "empty"])
def test_stages(spark, sf, kind):
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out = stored(out, name)
        got = out.collect()
        count = lambda rows: Counter((r.doc_id, r.text) for r in rows)
        if name == "quality":
            assert count(got) == Counter((d.doc_id, d.text) for d in given if brute_kept(d.text))
            out, got = (docs, given) if kind == "odd" else (out, got)  # go on with all the odd cases
        elif name == "lines":
            want = Counter((i, t) for i, t, n, cut in brute_lines(given) if not cut or WORD.search(t))
            assert count(got) == want
        elif name == "near_duplicates":
            kept = {r[0] for r in brute_near(given, 5, 80) if r[3]}
            want = [d for d in given if d.doc_id in kept]
            assert {r.doc_id for r in got} == {d.doc_id for d in want} and count(got).keys() <= count(want).keys()
            assert all(n == 1 for i, n in Counter(r.doc_id for r in got).items() if i is not None)
        elif name == "mixing":
            size, target = brute_mix(given)
            taken = defaultdict(int)
            for r in got:
                taken[r.source] += len(WORD.findall(r.text or ""))
            for s in size:
                assert abs(taken[s] - target[s]) <= max(len(WORD.findall(d.text or "")) for d in given if d.source == s)
            assert max(count(got).values(), default=0) <= 2 * max(count(given).values(), default=0)
        else:
            assert len({(r.doc_id, r.piece) for r in got}) == len({r.doc_id for r in got if r.piece == 0}) + sum(1 for x in {(r.doc_id, r.piece) for r in got} if x[1])
            assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(d.doc_id for d in given)
        docs = out


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count()
