"""The quality verdict on book-length texts: clean ones stay whatever their length, those that repeat themselves go."""

import random

import pyarrow.parquet as pq
import pytest
import zstandard

from tickframe.llm import quality

SIZES = (130_000, 300_000, 500_000, 1_000_000)


def clean_text(lang):
    """Kept documents joined, without lines that share four words in a row with an earlier document."""
    compress = zstandard.ZstdCompressor(level=3).compress
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"], filters=[("lang", "=", lang)]).column("text").to_pylist()
    random.Random(0).shuffle(rows)
    seen, out, size = set(), [], 0
    for text in rows:
        text = (text or "").encode()
        if size > SIZES[-1]:
            break
        if not quality.measured(text, compress)[-1]:
            continue
        new, keep = set(), []
        for line in text.split(b"\n"):
            words = line.lower().split()
            runs = {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))}
            if words and not runs & seen:
                keep.append(line)
            new |= runs
        seen |= new
        out.append(b"\n".join(keep))
        size += len(out[-1]) + 1
    return b"\n".join(out)


@pytest.mark.parametrize("lang", ["en", "de", "fr"])
def test_long_texts(lang):
    compress, text = zstandard.ZstdCompressor(level=3).compress, clean_text(lang)
    assert len(text) > SIZES[-1]
    for n in SIZES:
        assert quality.measured(text[:n], compress)[-1]
        assert not quality.measured(text[:n] + text[: n * 3 // 10], compress)[-1]
        at = n // 2
        assert not quality.measured(text[:at] + b"buy now " * 400 + text[at:n], compress)[-1]
