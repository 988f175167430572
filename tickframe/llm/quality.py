"""Quality rules: word and repetition counts, and compression bands by length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, mixed, table, texts_of, word_hashes

CHUNK = 1024
#: Up to so many bytes: whole-text ratio at least, at most; chunk ratio at least, at most.
#: Fitted to labelled clean and poor texts; chunks are fixed spans of CHUNK bytes, a shorter rest counts from half on.
BANDS = (
    (300, 0.40, 1.10, 0.40, 0.95),
    (600, 0.48, 0.80, 0.48, 0.80),
    (1200, 0.475, 0.74, 0.475, 0.76),
    (2500, 0.452, 0.66, 0.492, 0.76),
    (5000, 0.430, 0.60, 0.492, 0.76),
    (10000, 0.418, 0.56, 0.492, 0.76),
    (30000, 0.395, 0.52, 0.490, 0.76),
    (1 << 62, 0.385, 0.50, 0.490, 0.76),
)
#: Of longer texts the mean ratio of windows of so many bytes is held against the limits of that size, as the ratio of the
#: whole falls with length; clean texts of 1 MB have whole-text ratios of 0.90 to 0.95 of that mean, and one that
#: repeats itself over a distance less than FAR of it. The lowest of more chunks lies lower: DRIFT for each doubling.
WINDOW, FAR, DRIFT = 1 << 15, 0.85, 0.005
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, low_chunk double, high_chunk double, kept boolean"
_SYMBOLS = b"#*$%&|<>"
_STRIP = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_TAILS = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def repeated(words: list[bytes]) -> int:
    """Words inside a 3-word window whose words occur twice or more in the text, the first time included."""
    if len(words) < 4:
        return 0
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        run = mixed(mixed(mixed(h[:-2]) + h[1:-1]) + h[2:])
    _, inverse, count = np.unique(run, return_inverse=True, return_counts=True)
    at = np.zeros(len(h) + 1, np.int64)
    hits = np.flatnonzero(count[inverse] > 1)
    np.add.at(at, hits, 1)
    np.add.at(at, hits + 3, -1)
    return int((np.cumsum(at)[:-1] > 0).sum())


def measured(text: bytes, compress) -> tuple:
    """The row of one text, by _SCHEMA."""
    words = text.split()
    chars = len(text.translate(None, _TAILS + _SPACE))
    symbols = len(text.translate(None, _STRIP))
    lines = [x for x in text.split(b"\n") if x.split()]
    again = repeated(words)
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    ratio = low = high = None
    kept = False
    if text:
        ratio = len(compress(text)) / len(text)
        parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        rates = [len(compress(x)) / len(x) for x in parts if 2 * len(x) >= CHUNK]
        low, high = (min(rates), max(rates)) if rates else (ratio, ratio)
        _, least, most, chunk_least, chunk_most = next(b for b in BANDS if min(len(text), WINDOW) <= b[0])
        mean = ratio
        if len(text) > WINDOW:
            mean = sum(len(compress(text[i : i + WINDOW])) for i in range(0, len(text), WINDOW)) / len(text)
            chunk_least -= DRIFT * np.log2(len(text) / WINDOW)
        kept = bool(not failed and least <= mean <= most and ratio >= FAR * mean and (not rates or (chunk_least <= low and high <= chunk_most)))
    return len(words), chars, symbols, len(lines) - len(set(lines)), again, failed, ratio, low, high, kept


def quality(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): the counts of the base rules, compression ratios and the verdict.

    zstandard (level 3) compresses the whole text and each chunk of CHUNK bytes; a text whose ratios
    leave the band of its length is repetitive (below) or incompressible (above). Everything is computed
    in one pass without a shuffle. Null text counts as empty: 0 words, so base_failed and not kept; its
    ratios are null. Null doc_id and repeated rows pass through, one row each. Other columns are ignored.
    """

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = list(zip(*(measured(x, compress) for x in texts_of(batch)), strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            cols = [pa.array(x, t) for x, t in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *[x.split()[0] for x in _SCHEMA.split(", ")]])

    docs = bounded(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that quality() keeps; no shuffle: the verdict is reached where the row is."""

    def run(batches):
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield batch.filter(pa.array([measured(x, compress)[-1] for x in texts_of(batch)], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "low_chunk", "high_chunk")
