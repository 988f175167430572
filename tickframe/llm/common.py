"""What the training-data operators share: reading, the shared folder, hashing, words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: any run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts may be very long.
ROWS = 512


def bounded(docs: DataFrame) -> DataFrame:
    """docs, after its session's Arrow batches have been brought down to ROWS rows where they are larger."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name like name that docs doesn't have, in any case."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves in local mode only; a cluster without
    the setting is an error, as a folder of one machine would lose rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tickframe.shared.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("tickframe.shared.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tickframe/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read from there: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a side, and elements of its lists, that joins hold in every task (some tens of MB); more is shuffled.
HELD, HELD_ELEMENTS = 250_000, 1_000_000


def checked(side: DataFrame, elements: str | None = None) -> DataFrame:
    """side (a stored table of fixed columns and at most one list, elements) for a join: broadcast if small, else as it is."""
    rows, size = side.agg(F.count("*"), F.coalesce(F.sum(F.size(elements)), F.lit(0)) if elements else F.lit(0)).first()
    return F.broadcast(side) if rows <= HELD and size <= HELD_ELEMENTS else side


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of uint64 values (wrapping)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def lower_words(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z; bytes.split() parts at exactly the bytes 0x20 and 0x09 to 0x0D."""
    return text.lower().split()


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; fewer words make one run; none make none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    with np.errstate(over="ignore"):
        n = max(len(h) - k + 1, 1)
        run = np.full(n, np.uint64(min(len(h), k)), np.uint64)
        for j in range(min(k, len(h))):
            run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(run)


def texts_of(batch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def lowest(rows: DataFrame, limit: int, total: int, *columns: str) -> DataFrame:
    """At most limit of total rows, those with the lowest hashes of columns: a sample alike on every run.

    Rows above twice the hash that limit calls for are left out first, so tasks send some 2 * limit rows in all.
    """
    key = F.xxhash64(*columns)
    share = min(1.0, (2 * limit + 200) / max(total, 1))
    return rows.where(F.shiftrightunsigned(key, 33) <= int(share * (1 << 31))).orderBy(key, *columns).limit(limit)


def frequent(counts: DataFrame, key: str, limit: int, max_bytes: int) -> list:
    """Rows of counts (key, n, ...) with the largest n: never more than limit, nor than max_bytes of keys in all.

    A histogram of n by logarithm (a fixed number of bins) gives the least n that fits, so tasks send no
    candidates of their own; rows of equal n are in or out together, bar the resolution of a bin.
    """
    binned = counts.withColumn("_bin", F.floor(F.log2(F.col("n").cast("double")) * 32))
    left, room, least = limit, max_bytes, None
    for r in sorted(binned.groupBy("_bin").agg(F.count("*").alias("c"), F.sum(F.octet_length(key)).alias("size")).collect(), key=lambda r: -r["_bin"]):
        if r["c"] > left or r["size"] > room:
            break
        left, room, least = left - r["c"], room - r["size"], r["_bin"]
    return [] if least is None else binned.where(F.col("_bin") >= least).drop("_bin").collect()


#: A task joins components over so many edges at most.
EDGES = 1 << 20


def forest(edges: DataFrame) -> DataFrame:
    """(a, b): each node with the smallest id of its component over the edges of its own task."""

    def run(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x):
            top = x
            while (over := up.get(top, top)) != top:
                top = over
            while (over := up.get(x, x)) != top:
                up[x], x = top, over
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        for i in range(0, len(nodes), 100_000):
            part = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): component is the smallest id that a node reaches.

    Tasks first reduce EDGES edges each to a forest of stars; a single such task has the answer. Of more,
    large-star and small-star steps alternate with that until nothing changes. Each step is a minimum per
    node (combined before the shuffle) and a join that Spark can split, so one very large component does not
    meet in one task; nothing is collected but two totals a round.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    seen = None
    while True:
        tasks = -(-edges.count() // EDGES)
        if tasks > 1:
            edges = edges.repartition(tasks)
        edges = stored(forest(edges.coalesce(max(1, tasks))), "forest")
        if tasks <= 1:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        seen = now
