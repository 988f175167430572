"""Exact top-k inner products by best-first search in M-trees of bounded size."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, lowest, stored, table

#: Entries of a leaf page, children of an inner page, vectors of a tree, queries of a block; vectors, of all,
#: that give queries their first bound, and of these at most so many as there are trees' worths, that part the others.
PAGE, FAN, TREE, BLOCK, SAMPLE = 256, 16, 4096, 512, 1024
#: Bounds are distances in floating point; they give way by this part of the largest norm.
SLACK = 1e-6


def scaled(vectors: list) -> np.ndarray:
    return np.floor(1024 * np.asarray(vectors, np.float64))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """One more component, so that all vectors have length norm: the nearest to (q, 0) has the largest inner product with q."""
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]], 1)


def build(ids: np.ndarray, x: np.ndarray, norm: float) -> dict:
    """A tree as pages. Every page has a centre, a covering radius and the distance to its parent's centre; the
    entries of a leaf page lie in a row of ids and x, each with its distance to the page's centre."""
    up = lifted(x, norm)
    pages: list[dict] = []
    order: list[int] = []
    away = np.zeros(len(x))
    rng = np.random.default_rng(11)

    def page(rows: np.ndarray, parent: np.ndarray | None) -> int:
        centre = up[rows].mean(0)
        d = np.linalg.norm(up[rows] - centre, axis=1)
        own = {"centre": centre, "radius": float(d.max()), "parent": 0.0 if parent is None else float(np.linalg.norm(centre - parent)), "children": None}
        pages.append(own)
        at = len(pages) - 1
        if len(rows) <= PAGE:
            away[rows] = d
            own["from"], own["to"] = len(order), len(order) + len(rows)
            order.extend(rows)
            return at
        fan = min(FAN, max(2, -(-2 * len(rows) // PAGE)))
        routers = up[rng.choice(rows, fan, replace=False)]
        near = ((up[rows] ** 2).sum(1)[:, None] - 2 * up[rows] @ routers.T + (routers**2).sum(1)).argmin(1)
        parts = [rows[near == k] for k in range(fan)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):  # copies of one vector
            parts = np.array_split(rows, fan)
        children = [page(p, centre) for p in parts]
        own["children"] = np.array(children)
        own["centres"] = np.stack([pages[c]["centre"] for c in children])
        own["radii"] = np.array([pages[c]["radius"] for c in children])
        own["aways"] = np.array([pages[c]["parent"] for c in children])
        return at

    page(np.arange(len(x)), None)
    order_ = np.array(order)
    return {"ids": ids[order_], "x": x[order_], "away": away[order_], "pages": pages}


def search(tree: dict, q: np.ndarray, own: int, k: int, norm: float, least: float = -np.inf) -> tuple[list[tuple[float, int]], int]:
    """The k best (score, id) of the tree for q without id own, scores below least left out; inner products computed.

    Pages wait by their least possible distance. A child is first held against what its distance to the parent
    and the parent's to q leave possible, and only then is its own distance computed; so are a leaf's entries.
    """
    to = np.append(q, 0.0)
    square = norm**2 + float(q @ q)
    best: list[tuple[float, int]] = []  # (score, -id): the worst first
    slack = SLACK * max(norm, 1.0)

    def reach() -> float:
        worst = max(least, best[0][0]) if len(best) == k else least
        return np.sqrt(max(square - 2 * worst, 0)) + slack if worst > -np.inf else np.inf

    root = tree["pages"][0]
    d = float(np.linalg.norm(to - root["centre"]))
    wait, computed = [(d - root["radius"], 0, d)], 0
    while wait:
        low, at, d = heapq.heappop(wait)
        limit = reach()
        if low > limit:
            break
        own_page = tree["pages"][at]
        if own_page["children"] is None:
            a, b = own_page["from"], own_page["to"]
            rows = a + np.flatnonzero(np.abs(d - tree["away"][a:b]) <= limit)
            scores = tree["x"][rows] @ q
            computed += len(rows)
            fit = scores >= max(least, best[0][0] if len(best) == k else -np.inf)
            for s, i in zip(scores[fit].tolist(), tree["ids"][rows[fit]].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            continue
        may = np.flatnonzero(np.abs(d - own_page["aways"]) - own_page["radii"] <= limit)
        ds = np.linalg.norm(own_page["centres"][may] - to, axis=1)
        for j, dj in zip(may, ds, strict=True):
            if (low := dj - own_page["radii"][j]) <= limit:
                heapq.heappush(wait, (float(low), int(own_page["children"][j]), float(dj)))
    return [(s, -i) for s, i in best], computed


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query with all other vectors.

    Both inputs: vec_id, embedding. Components become floor(1024 * x). A vector is a candidate for queries of
    its own length only. Of SAMPLE vectors (a fixed number, lowest hashes), one for each TREE vectors there are
    parts the others by the nearest of them; parts of more than TREE vectors are split by hash, so one very
    common vector fills many trees. Each tree is one bounded row of pages; queries go to the trees in blocks of
    BLOCK. The scores against the sample, whose vectors are candidates themselves, give each query a bound to
    begin with, and what a tree returns is ranked per query after a partial ranking. Ties go to the smaller
    vec_id. Results are exact.

    Left out: null vec_id; vectors null, empty, or holding a null or non-finite component. A query's own
    vec_id is never its result; equal rows of another vec_id each take a rank; equal queries count once.
    Empty tables give no rows. Components are taken to be below 2^20 in size, so that sums are exact.
    """
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    asked = queries.where(fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).distinct()
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * 1024).cast("double"), 2))
    most, n = kept.agg(F.max(square), F.count("*")).first()
    norm = float(np.sqrt(most or 0.0)) * (1 + 1e-9)
    routes = lowest(kept, SAMPLE, n, "vec_id").collect()
    parts = max(1, n // TREE)
    by_size: dict[int, tuple[list, list]] = {}
    for r in routes:
        ids, xs = by_size.setdefault(len(r.embedding), ([], []))
        ids.append(r.vec_id), xs.append(r.embedding)
    held = spark.sparkContext.broadcast({d: (np.array(i), scaled(x)) for d, (i, x) in by_size.items()})

    def part(batches):
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            dims = np.array([len(v) for v in vectors], np.int32)
            out = np.full(len(vectors), -1, np.int32)
            for d in np.unique(dims):
                if (near := held.value.get(int(d))) is not None:
                    at, routers = np.flatnonzero(dims == d), near[1][:parts]
                    out[at] = ((routers**2).sum(1) - 2 * scaled([vectors[i] for i in at]) @ routers.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(out)], ["vec_id", "embedding", "dims", "part"])

    parted = stored(kept.mapInArrow(part, "vec_id long, embedding array<double>, dims int, part int"), "parted")
    salts = stored(parted.groupBy("dims", "part").agg(F.ceil(F.count("*") / TREE).alias("salts")), "salts")
    parted = parted.join(checked(salts), ["dims", "part"])
    parted = parted.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.col("salts")))

    def grow(key, frame: pd.DataFrame) -> pd.DataFrame:
        tree = build(frame["vec_id"].to_numpy(), scaled(list(frame["embedding"])), norm)
        return pd.DataFrame({"dims": [key[0]], "part": [key[1]], "salt": [key[2]], "pages": [pickle.dumps(tree)]})

    trees = stored(parted.select("dims", "part", "salt", "vec_id", "embedding").groupBy("dims", "part", "salt").applyInPandas(grow, "dims int, part int, salt long, pages binary"), "trees")

    def bound(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near = held.value.get(len(v))
                scores = np.sort((near[1] @ scaled([v])[0])[near[0] != i]) if near is not None else []
                out.append(float(scores[-k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["vec_id", "embedding", "least"])

    asked = asked.mapInArrow(bound, "vec_id long, embedding array<double>, least double").withColumn("dims", F.size("embedding"))
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.lit(blocks)))
    asked = asked.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "embedding", "least")).alias("queries"))
    # a block of queries and a tree meet under the tree's own key: part by part, then by the salts of each part
    by_part = asked.withColumn("part", F.explode(F.sequence(F.lit(-1), F.lit(parts - 1))))
    by_tree = by_part.join(salts, ["dims", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    units = trees.join(by_tree, ["dims", "part", "salt"]).select("pages", "queries")

    def run(batches):
        last = None
        for batch in batches:
            for row in range(batch.num_rows):
                blob = batch.column(0)[row].as_py()
                if last is None or last[0] != blob:
                    last = (blob, pickle.loads(blob))
                out = []
                for q in batch.column(1)[row].as_py():
                    v = scaled([q["embedding"]])[0]
                    found, _ = search(last[1], v, q["vec_id"], k, norm, -np.inf if q["least"] is None else q["least"])
                    mark = hash(tuple(q["embedding"])) if q["embedding"] else 0
                    out += [(q["vec_id"], mark, i, int(s)) for s, i in found]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "mark", "vec_id", "score"])

    found = units.mapInArrow(run, "query_id long, mark long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP4_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
