"""Language-model scores of whole texts, with add-half unigram scores as a base."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, frequent, lower_words, stored, table, texts_of
from .lbl import DIM, Model

#: Words with a symbol of their own, classes of all others (by their last bytes), words whose counts each task holds,
#: and their bytes in all.
WORDS, CLASSES, HEAD, HEAD_BYTES = 1200, 64, 65_536, 4 << 20
#: A task trains whenever it has so many tokens, and sends tail words once it holds so many entries.
CHUNK, FLUSH = 1 << 18, 800_000
END = b"\n"  # no word holds it
_models: dict[str, Model] = {}


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def counts_of(docs: DataFrame) -> DataFrame:
    """(word, class, n) of docs; tasks combine their own counts first."""

    def run(batches):
        seen: Counter = Counter()
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                for x in texts_of(batch):
                    seen.update(lower_words(x))
                    seen[END] += 1
            if seen and (batch is None or len(seen) > 400_000):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([class_of(w) for w in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "class", "n"])
                seen = Counter()

    return docs.select("text").mapInArrow(run, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


class Head:
    """What each task holds of the most frequent words: their place, and by place count and symbol (-1: of a class)."""

    def __init__(self, counts: dict[bytes, int], number: dict[bytes, int]):
        self.place = {w: i for i, w in enumerate(counts)}
        self.count = np.array(list(counts.values()), np.int64)
        self.symbol = np.array([number.get(w, WORDS + class_of(w)) for w in counts], np.int64)
        self.own = np.array([w in number for w in counts], bool)
        self.log = np.log10(self.count + 0.5)


def placed(texts: list[bytes], head: Head) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Places of all texts' tokens in a row (-1: not in head), first places of texts, the words not in head, and each one's text."""
    get, never = head.place.get, itertools.repeat(-1)
    found, others, of = [], [], []
    end = np.array([head.place[END]], np.int32)
    for k, x in enumerate(texts):
        words = lower_words(x)
        own = np.fromiter(map(get, words, never), np.int32, len(words))
        found += (own, end)
        if len(out := np.flatnonzero(own < 0)):
            others += map(words.__getitem__, out.tolist())
            of.append(np.full(len(out), k, np.int64))
    lengths = np.fromiter(map(len, found), np.int64, len(found)).reshape(-1, 2).sum(1)
    first = np.cumsum(lengths) - lengths
    return np.concatenate(found).astype(np.int64), first, others, np.concatenate(of) if of else np.empty(0, np.int64)


def symbols(places: np.ndarray, others: list[bytes], head: Head) -> np.ndarray:
    out = head.symbol[places]
    out[places < 0] = [WORDS + class_of(w) for w in others]
    return out


def marks_of(first: np.ndarray, n: int) -> np.ndarray:
    starts = np.zeros(n, bool)
    starts[first] = True
    return starts


def trained(docs: DataFrame, held, frequency: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after two rounds over disjoint parts of docs, an eighth and the rest, that is one pass over all.

    In a round each task trains on its documents from the round's first weights, and the weights of all
    tasks are averaged by tokens: partial sums by row of the weights, a fixed number of rows at the end.
    """
    spark = docs.sparkSession
    weights = Model(frequency).w
    columns = [f"v{i}" for i in range(DIM)]

    def run(batches):
        model = Model(frequency)
        model.w = {k: v.copy() for k, v in given.value.items()}
        texts, size, total = [], 0, 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                texts += (new := texts_of(batch))
                size += sum(map(len, new))
            if texts and (batch is None or size > 6 * CHUNK):
                places, first, others, _ = placed(texts, held.value)
                model.train(symbols(places, others, held.value), marks_of(first, len(places)))
                total += len(places)
                texts, size = [], 0
        for k, (name, v) in enumerate(model.w.items()):
            if total:
                full = np.zeros((len(v), DIM))
                full[:, : v.shape[1]] = v * float(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(np.arange(len(v))), pa.array(np.full(len(v), float(total))), *[pa.array(full[:, i]) for i in range(DIM)]], ["k", "row", "total", *columns])

    part = F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0
    for chosen in (part, ~part):
        given = spark.sparkContext.broadcast(weights)
        out = docs.where(chosen).select("text").mapInArrow(run, "k long, row long, total double, " + ", ".join(f"{c} double" for c in columns))
        rows = out.groupBy("k", "row").agg(*[(F.sum(c) / F.sum("total")).alias(c) for c in columns]).collect()
        if rows:
            weights = {name: v.copy() for name, v in weights.items()}
            names = list(weights)
            for r in rows:
                v = weights[names[r[0]]]
                v[r[1]] = np.asarray(r[2 : 2 + v.shape[1]], np.float32)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Words after lower-casing A-Z, and an end, are tokens. Documents that are not held out are learnt from:
    counts of all their words (by a shuffle), and one pass of noise-contrastive training over all of them.
    The model's symbols are the WORDS most frequent words and CLASSES classes of the others, told apart by
    their last bytes. score is the sum of log10 P(symbol | the two before) and, for a word of a class,
    log10 of (c + 0.5) / (the class's tokens + 0.5 (its words + 1)): as in the base, all unseen words of a
    class share one place, so probabilities sum to one. Counts of the HEAD most frequent words are in
    every task; the others join by word, a task's documents per word in one row.

    Null text counts as empty: one token, the end. A null doc_id counts as an empty id. Rows are known by id
    and text: equal rows come back as often as they came in. With nothing to learn from, counts are 0 and
    the base is 0 per token. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    learnt = docs.where(~F.col("held_out"))
    counts = stored(counts_of(learnt), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = sorted(((bytes(r["word"]), r["n"]) for r in frequent(counts, "word", HEAD, HEAD_BYTES)), key=lambda x: (-x[1], x[0]))
    own = [w for w, _ in head if w != END][: WORDS - 1]
    number = {w: i for i, w in enumerate([END, *own])}
    end = counts.where(F.col("word") == F.lit(END)).agg(F.max("n")).first()[0] or 0
    known = dict(head) | {END: end}
    per_class = {r["class"]: [r["n"], r["v"]] for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    frequency = np.full(WORDS + CLASSES, 0.5)
    for w, i in number.items():
        frequency[i] += known[w]
        c = per_class.get(class_of(w))
        if c and known[w]:
            c[0], c[1] = c[0] - known[w], c[1] - 1
    of_class = np.array([per_class.get(k, (0, 0)) for k in range(CLASSES)], np.float64)
    frequency[WORDS:] += of_class[:, 0]
    rest = -np.log10(of_class[:, 0] + 0.5 * (of_class[:, 1] + 1))
    held = spark.sparkContext.broadcast(Head(known, number))
    weights = spark.sparkContext.broadcast(trained(learnt, held, frequency))
    version = xxhash.xxh3_64_hexdigest(b"".join(x.tobytes() for x in weights.value.values()))
    below = float(np.log10(n + 0.5 * (v + 1)))
    fields = [("word", pa.binary()), ("ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int32())), ("fs", pa.list_(pa.int64()))]
    fields += [("own", pa.list_(pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("held_out", pa.bool_())])))]
    out = pa.schema(fields)

    def run(batches):
        if version not in _models:
            _models.clear()
            _models[version] = Model(frequency)
            _models[version].w = weights.value
        model, head = _models[version], held.value
        number_of: defaultdict[bytes, int] = defaultdict()
        number_of.default_factory = number_of.__len__
        gathered: list[tuple[np.ndarray, ...]] = []
        entries = 0

        def rows():
            which, *values = (np.concatenate(c) for c in zip(*gathered, strict=True))
            order = np.argsort(which, kind="stable")
            values = [v[order] for v in values]
            ends = np.cumsum(np.bincount(which))
            words = list(number_of)
            for i in range(0, len(words), 20_000):
                low = ends[i - 1] if i else 0
                at = np.r_[low, ends[i : i + 20_000]]
                offsets = pa.array((at - low).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v[low : at[-1]], out.field(j + 1).type.value_type)) for j, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 20_000], pa.binary()), *lists, pa.nulls(len(at) - 1, out.field(4).type)], schema=out)

        for batch in itertools.chain(batches, [None]):
            ids, marks, own = [], [], []
            if batch is not None and batch.num_rows:
                texts = texts_of(batch)
                places, first, others, of = placed(texts, head)
                starts = marks_of(first, len(places))
                lengths = np.diff(np.r_[first, len(places)])
                syms = symbols(places, others, head)
                log = model.log10(syms, starts)
                of_class = syms >= WORDS
                log[of_class] += rest[syms[of_class] - WORDS]
                inside = places >= 0
                counted = np.where(inside, head.log[places], 0.0)
                log[of_class] += counted[of_class]
                base = np.add.reduceat(counted, first) - lengths * below
                seen = np.add.reduceat((inside & (head.count[places] > 0)).astype(np.int64), first)
                score = np.add.reduceat(log, first)
                for k, (doc_id, x, out_) in enumerate(zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True)):
                    digest = xxhash.xxh3_64_intdigest(x)
                    key = doc_id if doc_id is not None else digest - (1 << 63)
                    mark = (digest & 0x7FFFFFFE) | (doc_id is None)
                    ids.append(key), marks.append(mark)
                    own.append({"n_tokens": int(lengths[k]), "n_known": int(seen[k]), "base": float(base[k]), "score": float(score[k]), "held_out": out_})
                yield pa.RecordBatch.from_arrays([pa.array([b"\n%d" % (ids[0] % 4096)], pa.binary()), *[pa.array([c], f.type) for c, f in zip((ids, marks, [0] * len(ids), own), list(out)[1:], strict=True)]], schema=out)
                if others:
                    pairs, f = np.unique((of << 32) | np.fromiter(map(number_of.__getitem__, others), np.int64, len(others)), return_counts=True)
                    doc = pairs >> 32
                    gathered.append((pairs & 0xFFFFFFFF, np.array(ids, np.int64)[doc], np.array(marks, np.int32)[doc], f))
                    entries += len(pairs)
            if entries and (batch is None or entries > FLUSH):
                yield from rows()
                gathered.clear(), number_of.clear()
                entries = 0

    found = docs.mapInArrow(run, "word binary, ids array<long>, marks array<int>, fs array<long>, own array<struct<n_tokens:long,n_known:long,base:double,score:double,held_out:boolean>>")
    joined = found.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    empty = F.array().cast("array<struct<n_tokens:long,n_known:long,base:double,score:double,held_out:boolean>>")
    each = joined.select("n", F.explode(F.arrays_zip("ids", "marks", "fs", F.coalesce("own", empty).alias("own"))).alias("e"))
    more = F.when(F.col("f") > 0, F.col("f") * F.log10(F.col("n") + 0.5)).otherwise(0.0)
    each = each.select("n", F.col("e.ids").alias("id"), F.col("e.marks").alias("mark"), F.col("e.fs").alias("f"), "e.own").select(
        "id", "mark", more.alias("more"), F.when(F.col("n") > 0, F.col("f")).otherwise(0).alias("known"), "own.*"
    )
    each = each.groupBy("id", "mark").agg(F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.max("held_out").alias("held_out"), F.sum("known").alias("known"), F.max("n_known").alias("own_known"), F.sum("more").alias("more"), F.max("base").alias("base"), F.max("score").alias("score"))
    each = each.select(
        F.when(F.col("mark") % 2 == 0, F.col("id")).alias("doc_id"), "held_out", "n_tokens", (F.col("own_known") + F.expr("known div copies")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") / F.col("copies")).alias("base_score"), (F.col("score") + F.col("more") / F.col("copies")).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return each.drop("copy")


def op1_scores(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
