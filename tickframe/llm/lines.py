"""Line dedup by a deletion-neighbourhood join: copies and lines one word apart keep their earliest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bounded, lower_words, mixed, stored, table, texts_of, unused, word_hashes

#: Every line with a word goes as an exact copy; from NEAR words on also within one word of an earlier one.
LEAST, NEAR = 1, 10
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def digest(words: list[bytes]) -> tuple[int, int]:
    return tuple(int(v) for v in np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8"))


def halves(words: list[bytes]) -> list[int]:
    """Four keys, two of which two lines one word apart share one of at least.

    Of lines of n and of n or n + 1 words one word apart, the first n // 2 or the last n - n // 2 words agree.
    So a line shows both parts for its own n, and for n - 1 as the longer of two.
    """
    n = len(words)
    cut = []
    for m in (n, n - 1):
        for tag, part in ((0, words[: m // 2]), (1, words[n - (m - m // 2) :])):
            cut.append(xxhash.xxh3_64_intdigest(b" ".join(part), seed=2 * m + tag) - (1 << 63))
    return cut


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions): the line itself (position -1), then the line without each of its words.

    A line is the sum of its word hashes times powers of an odd number, so what is left without word i comes
    from the sums before and after it: all n variants take time in proportion to n.
    """
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        power = np.ones(len(h) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(h), _B, np.uint64), out=power[1:])
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[:-1], out=sums[1:])
        without = sums[:-1] + (sums[-1] - sums[1:]) * _B_INVERSE
        keys = mixed(np.concatenate([sums[-1:], without]))
        n = np.full(len(keys), len(h) - 1, np.uint64)
        n[0] += np.uint64(1)
        return mixed(keys + n).view(np.int64), np.arange(-1, len(h))


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether an edit of one word (change, insertion, deletion) at most makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def occurrences(docs: DataFrame, with_halves: bool = True) -> DataFrame:
    """doc_id, line_no, d1, d2 of each line of LEAST words or more; h0 to h3 from NEAR words on, if asked for."""
    names = ["doc_id", "line_no", "d1", "d2", "h0", "h1", "h2", "h3"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                for no, line in enumerate(text.split(b"\n")):
                    if len(words := lower_words(line)) >= LEAST:
                        rows.append((doc_id, no, *digest(words), *(halves(words) if with_halves and len(words) >= NEAR else (None,) * 4)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "line_no" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, line_no int, d1 long, d2 long, h0 long, h1 long, h2 long, h3 long")


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the id, or for null ids a hash of the text, and which it is.

    So rows without an id don't meet in one task when documents move to their marks.
    """
    key, known = unused(docs, "_key"), unused(docs, "_known")
    id_ = F.col("doc_id").cast("long")
    return docs.withColumns({key: F.coalesce(id_, F.xxhash64("text")), known: id_.isNotNull()}), key, known


def marked(at: tuple[DataFrame, str, str], marks: DataFrame, name: str) -> DataFrame:
    """The documents with all their columns and, last, what marks (doc_id, name; one row per id) has for them, or null.

    Both sides move by id, whatever their sizes. All uses in one query ask for the same columns of documents in the
    same partitioning, so Spark moves the texts once and reads what it moved again (ReusedExchange).
    """
    docs, key, known = at
    of, last = unused(docs, "_of"), unused(docs, "_marks")
    marks = marks.select(F.col("doc_id").alias(of), F.col(name).alias(last))
    joined = docs.join(marks.hint("shuffle_hash"), (docs[key] == marks[of]) & docs[known], "left")
    return joined.select(*[docs[c] for c in docs.columns if c not in (key, known)], last)


def suspects(at: tuple[DataFrame, str, str], owners: DataFrame) -> DataFrame:
    """doc_id, line_no, line: first occurrences that share half with another line."""
    half = F.explode(F.array("h0", "h1", "h2", "h3")).alias("key")
    keys = owners.where("h0 is not null").select(half, F.col("d1").alias("id"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    ids = keys.join(shared, "key", "left_semi").select(F.col("id").alias("d1")).distinct()
    wanted = owners.join(ids, "d1", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "d1")).alias("wanted"))
    found = marked(at, stored(wanted, "wanted"), "wanted")
    id_ = found.columns.index("doc_id")

    def run(batches):
        for batch in batches:
            rows = []
            batch = batch.filter(batch.column(batch.num_columns - 1).is_valid())
            for doc_id, text, wanted in zip(batch.column(id_).cast(pa.int64()).to_pylist(), texts_of(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = text.split(b"\n")
                for w in wanted:
                    if w["line_no"] < len(lines) and digest(words := lower_words(lines[w["line_no"]]))[0] == w["d1"]:
                        rows.append((doc_id, w["line_no"], b" ".join(words)))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "line_no", "line"])

    return found.mapInArrow(run, "doc_id long, line_no int, line binary").dropDuplicates(["doc_id", "line_no", "line"])


def close(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): those of lines with an earlier one within one word.

    Equal variants at one position are lines that differ in that word only, so the earliest of them is
    within the bound of all others; a line equal to another's variant is one word shorter. It is enough to
    compare with the earliest of each: groups are never paired off.
    """

    def run(batches):
        for batch in batches:
            keys, at, of = [], [], []
            for i, line in enumerate(batch.column(2).to_pylist()):
                k, p = variants(line.split(b" "))
                keys.append(k), at.append(p), of.append(np.full(len(k), i))
                if sum(map(len, keys)) > 200_000 or i == batch.num_rows - 1:
                    of_ = pa.array(np.concatenate(of))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(at).astype(np.int32)), batch.column(0).take(of_), batch.column(1).take(of_), batch.column(3).take(of_)], ["key", "at", "doc_id", "line_no", "id"])
                    keys, at, of = [], [], []

    lines = lines.withColumn("id", F.xxhash64("line"))
    rows = lines.mapInArrow(run, "key long, at int, doc_id long, line_no int, id long").withColumn("me", F.struct("doc_id", "line_no", "id"))
    first = rows.groupBy("key", "at").agg(F.min("me").alias("first"), F.count("*").alias("n"))
    # per key: the earliest at each position, and over positions; partial minima come first, so windows see few rows
    by_key = Window.partitionBy("key")
    first = first.withColumn("whole", F.min(F.when(F.col("at") < 0, F.col("first"))).over(by_key)).withColumn("cut", F.min(F.when(F.col("at") >= 0, F.col("first"))).over(by_key))
    first = first.where("n > 1 or (at >= 0 and whole is not null) or (at < 0 and cut is not null)")
    pairs = rows.join(first.drop("n"), ["key", "at"])
    other = F.explode(F.array(F.col("first"), F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole"))))
    pairs = pairs.select("me", other.alias("earlier")).where("earlier is not null and earlier < me").distinct()
    x = lines.select(F.struct("doc_id", "line_no", "id").alias("me"), F.col("line").alias("x"))
    y = lines.select(F.struct("doc_id", "line_no", "id").alias("earlier"), F.col("line").alias("y"))

    def check(batches):
        for batch in batches:
            yield batch.filter(pa.array([within_one(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)], pa.bool_()))

    pairs = pairs.join(x, "me").join(y, "earlier").select("me.doc_id", "me.line_no", "me.id", "x", "y")
    pairs = pairs.mapInArrow(check, pairs.schema)
    return pairs.select("doc_id", "line_no", F.col("x").alias("line")).distinct()


def repeats(docs: DataFrame, at: tuple[DataFrame, str, str]) -> DataFrame:
    """doc_id, line_no, d1 of every line of docs that goes; at is keyed(docs)."""
    found = occurrences(docs)
    owners = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line_no")).alias("o"), F.count("*").alias("n"), *[F.max(h).alias(h) for h in ("h0", "h1", "h2", "h3")])
    owners = stored(owners.select("d1", "d2", "o.doc_id", "o.line_no", "n", "h0", "h1", "h2", "h3"), "owners")
    several = owners.where("n > 1").select("d1", "d2", F.col("doc_id").alias("od"), F.col("line_no").alias("ol"))
    copies = occurrences(docs, with_halves=False).select("doc_id", "line_no", "d1", "d2").join(several, ["d1", "d2"]).where("doc_id <> od or line_no <> ol").select("doc_id", "line_no", "d1")

    def add_digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([digest(x.split(b" "))[0] for x in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "line_no", "d1"])

    near = close(suspects(at, owners)).mapInArrow(add_digest, "doc_id long, line_no int, d1 long")
    return copies.union(near)


def dedup_lines(docs: DataFrame, added: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with all columns, text without its repeated lines; and n_lines, n_dropped as the last two columns.

    Lines run over all documents in the order of doc_id and place in the text. Words are compared with A-Z in
    lower case and white space as one blank. A line with a word, however short, goes where an equal one came
    before; one of NEAR words or more also where another of NEAR words or more came before that an edit of
    one word makes equal, whether that one stays or not. Blank lines stay.

    All lines are first reduced to their distinct ones (earliest per digest). Only lines that share half with
    another (see halves, which loses no pair) emit their deletion variants, which join as hashed keys, and
    what joins is verified word by word. Texts move once, by id, to the places of their lines; there is one plan
    at every size, and nothing is broadcast by a count of rows.

    Null text stays null with 0 lines. Rows with a null doc_id take no part and stay whole. Equal rows are
    treated alike: each keeps the lines that the first keeps. An empty table gives no rows. Columns of docs
    may have any names; those of the names in added, which the last two columns take, are replaced. A column
    n_chars is brought up to date.
    """
    docs = bounded(docs).drop(*added)
    names = docs.columns
    at = keyed(docs)
    gone = repeats(docs, at).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "d1")).alias("gone"))
    joined = marked(at, gone, "gone")

    def run(batches):
        for batch in batches:
            texts, counts, cut = [], [], []
            at = names.index("text")
            nulls = batch.column(at).is_null().to_pylist()
            for text, null, drop in zip(texts_of(batch), nulls, batch.column(len(names)).to_pylist(), strict=True):
                lines = text.split(b"\n") if text else []
                drop = {(d["line_no"], d["d1"]) for d in drop or ()}
                at_ = {no for no, _ in drop}
                kept = [x for no, x in enumerate(lines) if no not in at_ or (no, digest(lower_words(x))[0]) not in drop]
                texts.append(None if null else b"\n".join(kept).decode())
                counts.append(len(lines)), cut.append(len(lines) - len(kept))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names and pa.types.is_integer(batch.schema.field(n := names.index("n_chars")).type):
                cols[n] = pa.array([old if t is None else len(t) for t, old in zip(texts, cols[n].to_pylist(), strict=True)], cols[n].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(cut, pa.int64())], [*names, *added])

    return joined.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]).add(added[0], "long").add(added[1], "long"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, its own columns, without repeated lines; documents that lost every line with a word go."""
    lines, dropped = unused(docs, "_lines"), unused(docs, "_dropped")
    out = dedup_lines(docs, (lines, dropped))
    return out.where((F.col(dropped) == 0) | F.col("text").rlike(WORD)).drop(lines, dropped)


def op5_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
