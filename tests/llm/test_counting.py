"""Mixing, quality rules and token counts against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickframe.llm import mixing, quality, tokens
from tickframe.llm.common import table

from .fixtures import odd_docs, rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_mix(docs, share=1.5, cap=2.0):
    size = defaultdict(int)
    for d in docs:
        size[d.source] += len(WORD.findall(d.text or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = share * sum(size.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in list(free):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= cap * size[s]:
                left += target[s] - cap * size[s]
                target[s] = cap * size[s]
                free.discard(s)
    return size, target


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_mix(spark, sf, kind):
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    got, given = mixing.mix(docs).collect(), docs.collect()
    size, target = brute_mix(given)
    assert len(got) == len(given)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in size:
        longest = max(r.size for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 2 * longest
    assert rows(mixing.mix(docs)) == sorted(map(tuple, got), key=repr)


def test_mix_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(mixing.OP8_SQL).fetchall(), key=repr)
    assert rows(mixing.op8_mixing(spark, sf)) == want


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    at = {i + j for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(at) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at), failed


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_quality_base(spark, sf, kind):
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got) == sorted(((d.doc_id, *brute_quality(d.text)) for d in docs.collect()), key=repr)
    assert not quality.quality(docs).where("base_failed and kept").count()


def test_quality_filter_keeps_columns_and_agrees(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    out = quality.filtered(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    labels = table(spark, sf, "labels").where("quality = 1 and toxic = 0").join(quality.quality(docs).where("not base_failed"), "doc_id")
    assert labels.where("kept").count() >= 0.97 * labels.count()


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_token_counts(spark, sf, kind, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    want = sorted(((d.doc_id, len((d.text or "").encode()), len(library.encode(d.text or "", add_special_tokens=False).ids)) for d in docs.collect()), key=repr)
    for head in (tokens.HEAD, 50):  # a small head sends more by the join
        monkeypatch.setattr(tokens, "HEAD", head)
        assert rows(tokens.count_tokens(docs, path)) == want


def test_hash_is_the_md5_prefix(spark):
    got = spark.range(7, 8).select(mixing.hashed(F.col("id")).alias("h")).first().h
    assert got == int(hashlib.md5(b"7").hexdigest()[:9], 16)


def test_pre_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pattern = tokens.Pattern()
    texts = [
        "Don't!! we'll SAY 'so',  it's\n\n 12,5 %\t-- ok...   ", "x<|endoftext|>Y <|endoftext|>  z<|ENDOFTEXT|>", "a　b  c\x1c d\x00,e f\u0085g",
        "\U0001f600! 日本語。テスト,x é ²½Ⅷ ٣", "word.word,word;...\r\n\r\n  !a? $5", "", "  \n\t ", " a", "a ", "'s 's''s", "\u201cso\u201d \u2014 \u2026 \u00aa\u00b5\u00ba\u00d7\u00f7\u00b2\u00bd\u00a0\u0085 \u00e9t\u00e9",
        "".join(map(chr, range(1, 256))), " ".join(map(chr, range(1, 256))), "".join(f" {chr(i)}{chr(i)}a" for i in range(0x2010, 0x203F)),
    ]
    for x in texts:
        want = len(library.encode(x, add_special_tokens=False).ids)
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in tokens.pieces_of(x, pattern)) == want, x


def test_counts_in_a_row_equal_single_ones():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    words = [" the", " \u00e9t\u00e9", " A", " \u00aa", "the", " 12", ".", " ", "\n", "<|endoftext|>", " \u65e5\u672c", " xq" * 1, " " + "ab" * 4000]
    assert tokens.counter(path)(words).tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert tokens.counter(path)([]).tolist() == []
