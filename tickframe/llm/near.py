"""Near-duplicates by a chosen-path set similarity join over minwise values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, components, lower_words, mixed, shingles, stored, table, texts_of, unused

#: Minwise values a set has; the branching of a tree is drawn from them.
WIDTH = 128
#: Independent trees and the depth at which nodes are first looked at. A node has one child and, at a rate of
#: 1 in 4, two: 1.25 = 1 / 0.8 on average, so paths neither die out nor multiply at a similarity of 0.8. A pair at
#: 0.8 stays together in one tree at a rate of 0.64 to this depth, and in none of 12 trees at 5 in a million.
TREES, DEPTH, SECOND = 12, 3, 0.25
#: Nodes of so many sets at most are compared pair by pair at once. In larger ones stars join what is close; nodes
#: that still have more than so many sets outside their main component branch on, up to so many more levels; then
#: the sets outside are compared with their node. Dense groups keep together for many levels, in ever more nodes, so
#: a lower OUTSIDE costs rows and finds the same: at 48, 2.1 million labelled rows on a table where 1024 has 0.14 million.
SMALL, OUTSIDE, MORE = 48, 1024, 4
#: Bits of an odd sketch: whether an odd number of a set's members fall on each.
BITS = 1024
#: Sets of a block, on the side outside a main component and on that of the node.
BLOCK_X, BLOCK_Y = 512, 2048
#: A set outside is first held against so many of the closest sets of each other component in a block; where none of
#: them is a link, against so many more, and at last against all.
CLOSEST = (4, 64, BLOCK_Y)
#: Of the 128 pairs of 2-bit values of two sketches, a pair at 0.8 differs in 19.2 on average, with a deviation of
#: 4.04: the bound lies five deviations off.
APART = 40
_SKETCH = ["s0", "s1", "s2", "s3"]


def _minwise(values: np.ndarray, salts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    best = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 8192):
            np.minimum(best, ((x[None, i : i + 8192] ^ salts[:, None]) * odds[:, None]).min(axis=1), out=best)
    return best


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set, null for an empty one), sig (WIDTH minwise values)."""

    def run(batches):
        rng = np.random.default_rng(20)
        salts, odds = rng.integers(0, 1 << 32, (2, WIDTH), dtype=np.uint32)
        odds |= np.uint32(1)
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for x in texts_of(batch):
                own = shingles(lower_words(x), k)
                n.append(len(own))
                if not len(own):
                    d1.append(None), d2.append(None), sig.append(None)
                    continue
                a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8")
                d1.append(int(a)), d2.append(int(b)), sig.append(_minwise(own, salts, odds).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def children(leaf: int, level: int) -> list[tuple[int, int]]:
    """(number of the child, the value it branches by) of a node of a tree; drawn anew for each node, alike everywhere."""
    rng = np.random.default_rng([leaf, level, 77])
    return [(2 * leaf + b, int(rng.integers(WIDTH))) for b in range(1 + (rng.random() < SECOND))]


def first_nodes() -> list[tuple[int, list[int]]]:
    """(number, values on the path) of all trees' nodes at DEPTH."""
    nodes = [(TREES + t, []) for t in range(TREES)]
    for level in range(DEPTH):
        nodes = [(child, [*path, value]) for leaf, path in nodes for child, value in children(leaf, level)]
    return nodes


def branched(reps: DataFrame, level: int | None = None) -> DataFrame:
    """key, leaf, rep, sketch: each set's nodes at DEPTH; or, given rows with key, leaf and label, their children at level, with label."""
    more = [] if level is None else ["label"]
    names = ["key", "leaf", "rep", *_SKETCH, *more]

    def run(batches):
        shift = (2 * np.arange(32)).astype(np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(0)
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, WIDTH)
            two = ((sig & 3).astype(np.uint64).reshape(len(sig), 4, 32) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)
            v = sig.astype(np.uint64)

            def out(at, key, leaf):
                return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(leaf, pa.int64()), rep.take(pa.array(at)), *[pa.array(two[at, j]) for j in range(4)], *[batch.column(4).take(pa.array(at)) for _ in more]], names)

            with np.errstate(over="ignore"):
                if level is None:
                    every = np.arange(len(sig))
                    for leaf, path in first_nodes():
                        key = np.full(len(sig), np.uint64(leaf * 2654435761))
                        for c in path:
                            key = mixed(key * np.uint64(31) + v[:, c] + np.uint64(1))
                        yield out(every, key, np.full(len(sig), leaf))
                else:
                    keys, leaves = (batch.column(c).to_numpy() for c in (2, 3))
                    for leaf in np.unique(leaves):
                        at = np.flatnonzero(leaves == leaf)
                        for child, c in children(int(leaf), level):
                            key = mixed(keys[at].view(np.uint64) * np.uint64(31) + v[at, c] + np.uint64(1 + child % 2))
                            yield out(at, key, np.full(len(at), child))

    return reps.mapInArrow(run, "key long, leaf long, rep long, s0 long, s1 long, s2 long, s3 long" + ", label long" * len(more))


def alike() -> Column:
    """Whether the sketches of x and y (aliases) differ in APART places at most."""
    apart = F.lit(0)
    for s in _SKETCH:
        v = F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))
        apart = apart + F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return apart <= APART


def odd_sketch(members: np.ndarray) -> tuple[int, list[int], list[bytes]]:
    """level, and for it and the next level the members sampled and their odd sketch.

    Level l takes one in 2^l members, by hash, such that BITS at most are expected. Two sets at 0.8 are at
    equal or neighbouring levels, so they have one in common.
    """
    level = max(0, int(np.ceil(np.log2(max(len(members), 1) / BITS))))
    counts, sketches = [], []
    for k in (level, level + 1):
        own = members[(members >> np.uint64(40)) & np.uint64((1 << k) - 1) == 0]
        counts.append(len(own))
        odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
        sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return level, counts, sketches


def close_enough(x: pd.Series, y: pd.DataFrame, sketches: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of y whose odd sketches allow a similarity of percent with x, and for them the share in which they differ.

    Sketches differ in one bit at most for each member that only one of the sets has, and those are at most
    (100 - percent) / (100 + percent) of both sizes: without sampling no pair is lost, and with it the bound
    leaves room for five deviations of the sample.
    """
    rows, shares = [], []
    for step, own, other in ((0, "o", "o"), (1, "o", "p"), (-1, "p", "o")):
        at = np.flatnonzero(y["level"].to_numpy() == x["level"] - step)
        if not len(at):
            continue
        differ = np.bitwise_count(sketches[other][at] ^ np.frombuffer(x[own], np.uint64)).sum(1, dtype=np.int64)
        both = x["c0" if own == "o" else "c1"] + y["c0" if other == "o" else "c1"].to_numpy()[at]
        most = both * ((100 - percent) / (100 + percent))
        ok = differ <= most + (5 * np.sqrt(most) if step != 0 or x["level"] > 0 else 0)
        rows.append(at[ok]), shares.append(differ[ok] / np.maximum(both[ok], 1))
    return (np.concatenate(rows), np.concatenate(shares)) if rows else (np.empty(0, np.int64), np.empty(0))


def firsts(groups: np.ndarray, by: np.ndarray, most: int) -> np.ndarray:
    """Positions of the most lowest values of by in each group."""
    order = np.lexsort((by, groups))
    start = np.r_[True, groups[order][1:] != groups[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < most]


def sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """doc_id, members, level, c0, c1, o, p: odd sketches and the full sets of the documents in ids, written once.

    ids grow with docs, so they are never broadcast: the plan is one and the same at every size.
    """

    def run(batches):
        for batch in batches:
            sets = [shingles(lower_words(x), k) for x in texts_of(batch)]
            rows = [(level, *counts, *sketches) for level, counts, sketches in map(odd_sketch, sets)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "members", "level", "c0", "c1", "o", "p"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return stored(chosen.mapInArrow(run, "doc_id long, members array<long>, level long, c0 long, c1 long, o binary, p binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("all")).where(100 * F.col("common") >= percent * F.col("all")).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, links: DataFrame) -> DataFrame:
    """links and the verified ones that join all that the pairs (a < b, may repeat) can join.

    First each set with its smallest partner; of the other pairs only those whose ends that left apart.
    """
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(stored(verified(first, sets, percent), "links"))
    # those that were tried and failed come again, once each
    rest = stored(apart(pairs, components(links)).distinct(), "rest")
    return links if rest.isEmpty() else links.union(stored(verified(rest, sets, percent), "links"))


def apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    out = pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def labelled(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (key, leaf, rep, sketch) with label, their component so far."""
    return rows.join(of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")


def mixed_nodes(rows: DataFrame) -> DataFrame:
    """The labelled rows of nodes with several labels, with main, the most frequent, outside, the number of others, and n, that of all."""
    rows = stored(rows, "labelled")  # read twice
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    size = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n")).where("top.c < n")
    return stored(rows.join(size.select("key", F.col("top.label").alias("main"), (F.col("n") - F.col("top.c")).alias("outside"), "n"), "key"), "mixed")


def _pairs(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
    """Distinct pairs of alike sets of one node that fulfil on."""
    out = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & on & alike())
    return out.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def each_pair(rows: DataFrame) -> DataFrame:
    return _pairs(rows, rows, F.col("x.rep") < F.col("y.rep"))


def stars(rows: DataFrame) -> DataFrame:
    """Pairs of a set and its node's centre, of different labels; the centre is drawn by node, so trees have different ones."""
    one = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key"), "rep", "label", *_SKETCH)).alias("p")).select("key", "p.rep", "p.label", *[F.col(f"p.{s}").alias(s) for s in _SKETCH])
    return _pairs(rows, one, F.col("x.label") != F.col("y.label"))


def outsiders(mixed_: DataFrame, sets: DataFrame, percent: int, most: int, tried: DataFrame | None) -> DataFrame:
    """key, x, y, more: each set outside its node's main component with the sets of other labels that odd sketches allow.

    Of each label in a block the most closest come, without pairs that were tried before, so what comes out
    follows the sets and not their pairs; more tells whether some were held back. Given what was tried, only the
    sets that had more in their node come again. Both sides are cut in blocks by hash, and a block of one meets a block of
    the other in one group, which is bounded whatever the size of the node.
    """
    left = None if tried is None else tried.where("more").select("key", F.col("x").alias("rep")).distinct()
    rows = mixed_.drop("leaf", *_SKETCH).join(sets.drop("members").withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.withColumn("xs", F.ceil(F.col("outside") / BLOCK_X)).withColumn("ys", F.ceil(F.col("n") / BLOCK_Y))
    zero = F.lit(0).cast("long")
    x = rows.where("label <> main").withColumn("side", F.lit(0)).withColumn("xb", F.pmod(F.xxhash64("rep"), "xs"))
    if tried is not None:
        x = x.join(left, ["key", "rep"], "left_semi")
        x = x.join(tried.select(F.col("x").alias("rep"), "y").distinct().groupBy("rep").agg(F.collect_list("y").alias("tried")), "rep", "left")
    x = x.withColumn("yb", F.explode(F.sequence(zero, F.col("ys") - 1)))
    y = rows.withColumn("side", F.lit(1)).withColumn("xb", F.explode(F.sequence(zero, F.col("xs") - 1))).withColumn("yb", F.pmod(F.xxhash64("rep"), "ys"))

    again = tried is not None

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["side"] == 0], frame[frame["side"] == 1]
        sketches = {c: np.frombuffer(b"".join(y[c]), np.uint64).reshape(len(y), -1) for c in "op"}
        rep, label = y["rep"].to_numpy(), y["label"].to_numpy()
        inside = label == y["main"].to_numpy()
        out = [np.empty((0, 4), np.int64)]
        key = frame["key"].iloc[0]
        for _, row in x.iterrows():
            at, share = close_enough(row, y, sketches, percent)
            ok = (label[at] != row["label"]) & (inside[at] | (rep[at] > row["rep"]))
            if again and row["tried"] is not None:
                ok &= ~np.isin(rep[at], row["tried"])
            first = at[ok][firsts(label[at[ok]], share[ok], most)]
            out.append(np.stack([np.full(len(first), key), np.full(len(first), row["rep"]), rep[first], np.full(len(first), len(first) < ok.sum())], 1))
        return pd.DataFrame(np.concatenate(out), columns=["key", "x", "y", "more"]).astype({"more": bool})

    both = x.unionByName(y, allowMissingColumns=True)
    return both.groupBy("key", "xb", "yb").applyInPandas(compare, "key long, x long, y long, more boolean")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and cut into sets of k-word shingles; documents whose sets have a
    similarity of percent / 100 or more are linked. Equal sets are one class first, known by its smallest
    doc_id. Classes then walk TREES chosen-path trees; a node's sets share the minwise values on its path.
    Small nodes are compared pair by pair, by sketch, and what passes on full sets. In a larger node each set
    meets one set of that node, another in each tree. Nodes of one component end; those where many sets are
    outside the main one branch on. Of the nodes that are left, the sets outside are compared with their node, by
    sketches and then on full sets: first with the closest of each other component, then with more, until no pair
    that sketches allow is left untried between different components. So what is sent follows the sets and their
    links, not the square of a group, and nothing is left out.

    Null or empty text, or one without a word: an empty set, linked with nothing, component_id its own doc_id.
    Null doc_id: takes no part; component_id is null, kept true. Rows with equal doc_id are one node: their
    sets' links hold for all of them. An empty table gives no rows. Other columns are ignored.
    """
    all_rows = stored(signatures(docs, k), "signatures")
    sets = all_rows.where("doc_id is not null and d1 is not null")
    classes = sets.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select("d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig"))
    classes = stored(classes, "classes")
    reps = classes.select("rep", "sig")
    member = stored(sets.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "n_shingles", "rep"), "members")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("l"), F.max("rep").alias("h")).where("l <> h").select("doc_id")
    links = member.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")

    nodes, level = branched(reps), DEPTH
    size = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    nodes = stored(nodes.join(size, "key"), "nodes")
    large = nodes.where(F.col("n") > SMALL).drop("n")
    pairs = stored(each_pair(nodes.where(F.col("n") <= SMALL)).union(stars(large.withColumn("label", F.col("rep")))), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(large.select("rep")).distinct()
    members = sets_of(ids, docs, k)
    links = linked(pairs, members, percent, links)
    of = components(links)
    ended = None
    while not (mixed_ := mixed_nodes(labelled(large, of))).isEmpty():
        ends = (F.col("outside") <= OUTSIDE) | F.lit(level >= DEPTH + MORE)
        now = mixed_.where(ends).select("key", "leaf", "rep", *_SKETCH)
        ended = now if ended is None else ended.union(now)
        onward = mixed_.where(~ends).select("rep", "key", "leaf", "label")
        if onward.isEmpty():
            break
        large = stored(branched(onward.join(reps, "rep").select("rep", "sig", "key", "leaf", "label"), level), "nodes")
        pairs = stored(stars(large), "pairs")
        large = large.drop("label")
        if not pairs.isEmpty():
            links = linked(pairs, members, percent, links)
            of = components(links)
        level += 1
    tried = None
    for most in CLOSEST if ended is not None else ():
        if (mixed_ := mixed_nodes(labelled(ended, of))).isEmpty():
            break
        pairs = stored(outsiders(mixed_, members, percent, most, tried), "outsiders")
        tried = pairs if tried is None else tried.union(pairs)
        links = linked(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), members, percent, links)
        of = components(links)
        if (more := pairs.where("more").select("key").distinct()).isEmpty():
            break
        ended = ended.join(more, "key", "left_semi")
    found = member.join(of.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    found = found.union(all_rows.where("doc_id is null or d1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps.

    Of rows equal in doc_id and text one stays, that with the lowest hash of its other columns (maps aside). Rows of
    one doc_id with other texts are one node, so they stay or go together. Rows with a null doc_id stay.
    """
    kept = stored(near_duplicates(docs, k, percent).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")), "kept")
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")
    again = kept.where("_n > 1 and _id is not null")
    if again.isEmpty():
        return out
    is_again = docs["doc_id"].cast("long") == again["_id"]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.xxhash64(*plain)))
    copies = out.join(again, is_again, "left_semi").withColumn(rank := unused(docs, "rank"), first)
    return out.join(again, is_again, "left_anti").union(copies.where(F.col(rank) == 1).drop(rank))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


#: All pairs that share a shingle, and components by reachability: for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.root FROM r JOIN both_ways b ON r.node = b.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON n.doc_id = r.node GROUP BY n.doc_id, n.n
"""
