"""Line dedup against a plain scan over all earlier lines."""

import random
import re

import pytest

from tickframe.llm import common, lines
from tickframe.llm.common import table

from .fixtures import odd_docs, rows


def cut(line):
    return tuple(re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), line)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs):
    own = sorted({(d.doc_id, no, cut(x)) for d in docs if d.doc_id is not None and d.text for no, x in enumerate(d.text.split("\n")) if len(cut(x)) >= lines.LEAST}, key=lambda r: r[:2])
    seen, order, gone = set(), [], set()
    for doc_id, no, words in own:
        if words in seen:
            gone.add((doc_id, no, words))
            continue
        seen.add(words)
        if len(words) >= lines.NEAR:
            if any(abs(len(words) - len(w)) <= 1 and (words[: len(words) // 3] == w[: len(words) // 3] or words[-(len(words) // 3) :] == w[-(len(words) // 3) :]) and edits(words, w) <= 1 for w in order):
                gone.add((doc_id, no, words))
            order.append(words)
    # a line that goes as close takes its later copies along: those went as copies
    out = []
    for d in docs:
        rows = d.text.split("\n") if d.text else []
        kept = [x for no, x in enumerate(rows) if d.doc_id is None or (d.doc_id, no, cut(x)) not in gone]
        out.append((d.doc_id, None if d.text is None else "\n".join(kept), len(rows), len(rows) - len(kept)))
    return sorted(out, key=repr)


def near_docs(spark):
    rng = random.Random(2)
    word = [f"w{i}" for i in range(50)]
    out = []
    for g in range(25):
        base = [rng.choice(word) for _ in range(rng.choice((9, 10, 11, 25)))]
        for _ in range(8):
            x = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                k, how = rng.randrange(len(x)), rng.randrange(3)
                x[k : k + (how != 1)] = [rng.choice(word)] if how else []
            out.append(" ".join(x))
    rng.shuffle(out)
    return spark.createDataFrame([(i, "\n".join(out[4 * i : 4 * i + 4] + ["", "ok"]), 0, "l") for i in range(50)], "doc_id long, text string, n_chars int, line string")


@pytest.mark.parametrize("held", [250_000, 0])
@pytest.mark.parametrize("kind", ["near", "odd", "table", "empty"])
def test_dedup(spark, sf, kind, held, monkeypatch):
    monkeypatch.setattr(common, "HELD", held)
    docs = {"near": near_docs, "odd": odd_docs}.get(kind, lambda s: table(s, sf, "documents").limit(80 if kind == "table" else 0))(spark)
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = got.collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(docs.collect())
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    if kind == "near":
        assert sum(r.n_dropped for r in got) > 50


def test_short_lines_go_as_copies(spark):
    """Lines of one to four words, and lines of a script without blanks, go wherever an equal one came before."""
    chinese = "版权所有未经许可不得转载本网站的任何内容"
    texts = ["All rights reserved.\n\nok\n" + chinese, "first\nall  RIGHTS reserved.\n \n" + chinese, "OK\nfour words are here", "four words are here\nall rights\n\nfirst"]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = [(0, texts[0], 4, 0), (1, "first\n ", 4, 2), (2, "four words are here", 2, 1), (3, "all rights\n", 4, 2)]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice((b"a", b"b")) for _ in range(rng.randrange(1, 7))] for _ in range(2))
        assert lines.within_one(a, b) == (edits(a, b) <= 1)


def test_halves_lose_no_pair():
    rng = random.Random(1)
    for _ in range(2000):
        a = [rng.choice((b"a", b"b", b"c")) for _ in range(rng.randrange(10, 16))]
        b = list(a)
        k, how = rng.randrange(len(a)), rng.randrange(3)
        b[k : k + (how != 1)] = [b"x"] if how else []
        assert set(lines.halves(a)) & set(lines.halves(b))
        ka, kb = lines.variants(a), lines.variants(b)
        assert set(ka[0].tolist()) & set(kb[0].tolist())


def test_columns_of_the_counts_names_stay(spark):
    docs = spark.createDataFrame([(1, "one line\nanother line", 77, 5), (2, "one line\nits own", 78, 6)], "doc_id long, text string, n_lines int, N_Dropped int")
    got = lines.without_repeats(docs)
    assert got.columns == docs.columns and rows(got) == [(1, "one line\nanother line", 77, 5), (2, "its own", 78, 6)]


@pytest.mark.parametrize("columns", [["doc_id", "text"], ["*"]])
def test_texts_move_once(spark, sf, columns):
    """One plan at every size: what moves documents to the places of their lines is read again, not done again."""
    got = lines.dedup_lines(table(spark, sf, "documents").select(*columns))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in plan.split("\n") if "FileScan" in x and "text" in x]
    assert len(moved) == 2 and any("ReusedExchange" in x and "text" in x for x in plan.split("\n")), plan
