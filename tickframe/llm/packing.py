"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, partitions, stored, table, texts_of

#: Distinct words whose ids a worker remembers in each of two generations, some 200 bytes each, and the longest such word in bytes.
REMEMBER, REMEMBER_BYTES = 200_000, 64
#: What the library is given as one text: so many words of letters, apart by a space.
JOINED = 4000
#: Bytes of text, or one longer text, that are cut into words at a time.
SLICE = 1 << 19
#: Between a letter and a mark that cannot join it a space changes no token, and most words are then known without marks.
_MARK = re.compile(rb"[.,;:!?%$*&#)\]\"](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0400-\u045f]+")


def encoder(path: str):
    """texts (UTF-8) to the bytes of their ids (little-endian uint32), the same as the library's.

    For a tokenizer that drops white space, no token spans it: a text's ids are its words' ids in a row, so the
    library encodes each distinct word once while it is remembered. Words of letters alone are given to it many
    at a time: of such a word's tokens only the last ends a word, which shows where each word's ids end. What is
    remembered belongs to one task; words that were not met while a whole generation filled up are forgotten.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    ends = np.zeros(library.get_vocab_size(), bool)
    ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True
    known: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}

    def each(words: list[bytes]) -> dict[bytes, bytes]:
        return {w: np.asarray(e.ids, "<u4").tobytes() for w, e in zip(words, library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True)}

    def together(words: list[bytes]) -> dict[bytes, bytes]:
        ids = np.asarray(library.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cut = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cut) != len(words) or cut[-1] != 4 * len(ids):
            return each(words)
        ids = ids.tobytes()
        return {w: ids[i:j] for w, i, j in zip(words, [0, *cut], cut, strict=False)}

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal known, older
        if len(known) > REMEMBER:
            known, older = {}, known
        # the tokenizer lower-cases all but its special strings
        words = [(x if b"<|" in x else _MARK.sub(rb" \g<0>", x.lower())).split() for x in texts]
        new = []
        for w in set().union(*words):
            if w not in known:
                if (ids := older.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
        letters, others = [], []
        for w in new:
            (letters if _LETTERS.fullmatch(w.decode()) else others).append(w)
        for i in range(0, len(letters), JOINED):
            known.update(together(letters[i : i + JOINED]))
        known.update(each(others))
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        for w in [w for w in new if len(w) > REMEMBER_BYTES]:
            known.pop(w, None)
        return out

    return encode


def encoded(texts: list[bytes], encode):
    """The ids of each text, in slices of some SLICE bytes of text at a time."""
    size, part = 0, []
    for x in itertools.chain(texts, [None]):
        if part and (x is None or size + len(x) > SLICE):
            yield from encode(part)
            size, part = 0, []
        if x is not None:
            part.append(x)
            size += len(x)


def pieces(docs: DataFrame, path: str, size: int, end: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's ids and one end id, cut every size tokens."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    last = np.asarray([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            at, cols = [], [[] for _ in fields]
            for i, ids in enumerate(encoded(texts_of(batch), encode)):
                own = ids + last
                for k, j in enumerate(range(0, len(own), 4 * size)):
                    part = own[j : j + 4 * size]
                    at.append(i)
                    for c, v in zip(cols, (k, j // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)]], ["doc_id", *[n for n, _ in fields]])

    docs = bounded(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): ranks in a row go to sequences in a row.

    Lengths fall; each goes to the fullest sequences that still hold it, a run of equal sequences at a
    time, and else to new ones. Work and result depend on size and the distinct lengths, not on documents.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # by room left
    rooms: list[int] = []
    plan, sequences = [], 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
                take = min(many, n - rank)
                plan.append((length, rank, take, first, size - room))
                rank += take
                leave(room, first + take, many - take)
                leave(room - length, first, take)
                continue
            each = size // length
            full, rest = divmod(n - rank, each)
            for many, holds in ((full, each), (1, rest)):
                if many and holds:
                    for j in range(holds):
                        plan.append((length, rank, many, sequences, j * length))
                        rank += many
                    leave(size - holds * length, sequences, many)
                    sequences += many
    return plan


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of docs (doc_id, text).

    The histogram has at most size lengths, so the plan is made from it alone; pieces take the planned
    places by their rank among equal lengths. Ranks come from counts by (length, block) plus the rank
    within a block, as one length can be very frequent.

    Null text counts as empty: one piece, the end id. Null doc_id is kept. Equal rows are packed as often
    as they occur. Equal lengths rank by doc_id, start and checksum within a hash block. An empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, path, size, end, with_ids).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(16, partitions(spark)))))
    cut = stored(cut, "pieces")
    by_block = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(counts, size)
    order = np.array(sorted(plan), np.int64).reshape(-1, 5)
    slots = spark.sparkContext.broadcast(order)
    before = by_block.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("in_block", rank).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*names, "rank")

    def place(batches):
        length, first, _, sequence, offset = slots.value.T
        key = length * (1 << 44) + first
        for batch in batches:
            own = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            k = np.searchsorted(key, own * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[k] + rank - first[k]), pa.array(offset[k])], [*names, "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
