"""Packing: ids against the library, gapless sequences, few of them."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tickframe.llm import packing
from tickframe.llm.common import table

from .fixtures import odd_docs


def test_plan_places_every_rank_once():
    counts = {4096: 5, 3000: 7, 1096: 3, 700: 20, 11: 1000, 1: 50}
    plan = packing.best_fit(counts, 4096)
    taken = defaultdict(list)
    for length, first, many, sequence, offset in plan:
        for i in range(many):
            taken[sequence + i].append((offset, length))
    ranks = defaultdict(int)
    for length, first, many, *_ in sorted(plan):
        assert first == ranks[length]
        ranks[length] += many
    assert ranks == counts
    for parts in taken.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(taken) <= -(-sum(k * v for k, v in counts.items()) // 4096) + 1


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), packing.encoder(path)
    texts = [
        "Don't!! we'll SAY 'so', it's 12,5 % -- ok...", "x<|endoftext|>Y <|ENDOFTEXT|>, <|startoftext|>!", "A\u0301 e\u0301, \u00c9. \u0130 \u017f\u212a",
        "a\u3000b \u00a0c\x1c d\x00,e", "\U0001f600! 日本語。テスト,x", "word.word,word;... !a? $5 #tag &amp; 1st,", "", "  \n\t ", "ﬁ ß ẞ ǅ,",
    ]
    for x, got in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x
    for x in texts:
        assert np.frombuffer(encode([x.encode()])[0], "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("kind", ["odd", "table", "empty"])
def test_pack(spark, sf, kind):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = table(spark, sf, "documents") if kind == "table" else odd_docs(spark)
    docs = docs.limit(0) if kind == "empty" else docs
    got = packing.pack(docs, path).collect()
    want = []
    for d in docs.collect():
        ids = np.asarray([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((d.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= 1.02 * -(-sum(r.length for r in got) // 4096) + 1
