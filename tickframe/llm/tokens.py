"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, frequent, stored, table, texts_of

#: Frequent pre-tokens whose counts each task holds: so many at most, and so many bytes of strings in all.
HEAD, HEAD_BYTES = 65_536, 4 << 20
#: A task sends what it has gathered once it holds so many (pre-token, document) entries.
FLUSH = 1_500_000
#: Pre-tokens that the library is given in a row.
JOINED = 4000
_SPECIAL = "<|endoftext|>"
#: The letters, numbers and white space up to U+00FF; U+2010 to U+2027 and U+2030 to U+203E hold none of these.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_FURTHER = re.compile("[^\x00-\u00ff\u2010-\u2027\u2030-\u203e]")


class Pattern:
    """The tokenizer's pre-token pattern; texts of the characters named above take the same pattern with these sets spelt out,
    which the standard module runs in half the time."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.full = regex.compile(public_tokenizers.PATTERN)
        self.near = re.compile(f" ?[{_L}]+|'(?:[sdmt]|ll|ve|re)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

    def findall(self, text: str) -> list[str]:
        return (self.full if _FURTHER.search(text) else self.near).findall(text)


def pieces_of(text: str, pattern: Pattern) -> list[str]:
    """The pre-tokens of a text; a special string counts as one of its own, as the library has it by default."""
    if _SPECIAL not in text:
        return pattern.findall(text)
    out: list[str] = []
    for k, part in enumerate(text.split(_SPECIAL)):
        if k:
            out.append(_SPECIAL)
        out += pattern.findall(part)
    return out


def frequencies(docs: DataFrame) -> DataFrame:
    """(piece, n) of the whole table; tasks combine their own counts first."""

    def run(batches):
        pattern, seen = Pattern(), Counter()
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for x in texts_of(batch):
                    seen.update(pieces_of(x.decode(), pattern))
            if seen and (batch is None or len(seen) > 400_000):
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], schema=schema)
                seen = Counter()

    return docs.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def counter(path: str):
    """A function from distinct pre-tokens to their numbers of tokens, by the library.

    Pre-tokens of a blank and letters are given to it many in a row: they are the pre-tokens of that text, and of
    each only the first token begins with the blank, which shows where its tokens end.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    begins = np.zeros(library.get_vocab_size(), bool)
    begins[[i for token, i in library.get_vocab().items() if token.startswith("\u0120")]] = True
    plain = re.compile(f" [{_L}]+")

    def count(words: list[str]) -> np.ndarray:
        k = np.zeros(len(words), np.int64)
        in_a_row = np.array([plain.fullmatch(w) is not None for w in words], bool)
        at = np.flatnonzero(in_a_row)
        for i in range(0, len(at), JOINED):
            part = at[i : i + JOINED]
            ids = np.asarray(library.encode_batch_fast(["".join(words[j] for j in part)], add_special_tokens=False)[0].ids, np.int64)
            first = np.flatnonzero(begins[ids])
            if len(first) == len(part):
                k[part] = np.diff(np.r_[first, len(ids)])
            else:
                in_a_row[part] = False
        at = np.flatnonzero(~in_a_row)
        k[at] = [len(e.ids) for e in library.encode_batch_fast([words[j] for j in at], add_special_tokens=False)]
        return k

    return count


def counted(pieces: DataFrame, path: str) -> DataFrame:
    """(piece, n, k): k tokens for each distinct pre-token."""

    def run(batches):
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count(batch.column(0).to_pylist()))], ["piece", "n", "k"])

    return pieces.mapInArrow(run, "piece string, n long, k long")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs (doc_id, text), without forming any document's ids.

    Three steps: frequencies of all distinct pre-tokens; the library counts each of them once; each
    document's own frequencies join those counts. The HEAD most frequent ones (a fixed number and
    size) are summed inside the tasks, which also rids the join of its hot keys; all others are joined by
    a shuffle on the pre-token, a task's documents per pre-token as one row, and summed per document.

    Null text counts as empty: 0 bytes, 0 tokens. Rows are known by (doc_id, hash of the text), so a null
    doc_id is fine, equal rows come back as often as they came in, and equal ids with other texts stay
    apart. An empty table gives no rows. Other columns are ignored.
    """
    spark = bounded(docs).sparkSession
    vocabulary = stored(counted(frequencies(docs), path), "vocabulary")
    head = spark.sparkContext.broadcast({r.piece: r.k for r in frequent(vocabulary, "piece", HEAD, HEAD_BYTES)})
    out = pa.schema([("piece", pa.string()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("fs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def run(batches):
        pattern, known = Pattern(), head.value
        gathered: dict[str, tuple] = {}
        entries = 0

        def rows():
            keys = list(gathered)
            for i in range(0, len(keys), 20_000):
                part = [gathered[k] for k in keys[i : i + 20_000]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 20_000], pa.string()), *[pa.array([p[j] for p in part], t) for j, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.int32())), (2, pa.list_(pa.int64())))], pa.nulls(len(part), pa.list_(pa.int64()))], schema=out)

        for batch in itertools.chain(batches, [None]):
            own = ([], [], [], [])
            for doc_id, x in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True) if batch is not None else ():
                digest = xxhash.xxh3_64_intdigest(x)
                key = doc_id if doc_id is not None else digest - (1 << 63)
                mark = (digest & 0x7FFFFFFE) | (doc_id is None)
                total = 0
                for piece, f in Counter(pieces_of(x.decode(), pattern)).items():
                    k = known.get(piece)
                    if k is None:
                        got = gathered.get(piece)
                        if got is None:
                            gathered[piece] = ([key], [mark], [f])
                        else:
                            got[0].append(key)
                            got[1].append(mark)
                            got[2].append(f)
                        entries += 1
                    else:
                        total += k * f
                for column, v in zip(own, (key, mark, total, len(x)), strict=True):
                    column.append(v)
            if own[0]:  # what is summed already travels under a key that is no pre-token
                yield pa.RecordBatch.from_arrays([pa.array([f"\n\x00{own[0][0] % 4096}x"], pa.string()), *[pa.array([c], f.type) for c, f in zip(own, list(out)[1:], strict=True)]], schema=out)
            if entries and (batch is None or entries > FLUSH):
                yield from rows()
                gathered, entries = {}, 0

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "piece string, ids array<long>, marks array<int>, fs array<long>, sizes array<long>")
    joined = found.join(vocabulary.select("piece", "k"), "piece", "left")
    each = joined.select(F.coalesce("k", F.lit(1)).alias("k"), F.explode(F.arrays_zip("ids", "marks", "fs", F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"))).alias("e"))
    each = each.select(F.col("e.ids").alias("id"), F.col("e.marks").alias("mark"), (F.col("k") * F.col("e.fs")).alias("v"), F.col("e.sizes").alias("size"))
    each = each.groupBy("id", "mark").agg(F.sum("v").alias("v"), F.max("size").alias("n_bytes"), F.count("size").alias("copies"))
    each = each.select(F.when(F.col("mark") % 2 == 0, F.col("id")).alias("doc_id"), "n_bytes", (F.expr("v div copies")).alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
