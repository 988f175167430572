"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Hash bits: three digits of 12 bits, so a threshold is found in three histograms of 4096 bins.
DIGITS, BITS = 3, 12
WEIGHTS = (3, 1, 2)


def hashed(key: Column) -> Column:
    """A 36-bit number from the md5 of the key's text; null counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, DIGITS * BITS // 4), 16, 10).cast("long")


def targets(per_source: DataFrame, share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target: share of all sizes by weight, none above cap times its source.

    Sources in code point order, null last, take the weights in turn. Sources that reach their cap
    pass the rest on by weight; ordered by cap over weight, the capped ones are a prefix, so the level
    (target per weight of the others, the largest that fits) follows from running sums. One row per source is small: the
    windows without a partition run over that only.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = per_source.withColumn("weight", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(by), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by), F.lit(0.0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return rows.withColumn("at", level).select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("at")), F.col("most")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, hash: all that the thresholds need, written once."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return stored(docs.select("doc_id", "source", words.alias("size"), hashed(F.col("doc_id")).alias("hash")), "sized")


def thresholds(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """s, source_size, target, base, threshold: a row per source of sizes, the table that sized() gives.

    Every document is taken floor(target / source_size) times, and once more where its hash is below
    the source's threshold. The threshold is a number of DIGITS digits: each digit comes from one
    histogram of sizes by (source, digit) over the documents that share the digits so far, that is
    all documents, then the boundary bin alone, then its boundary bin. The last boundary bin is taken
    if that brings the source nearer its target. No sort of documents takes place.
    """
    plan = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    plan = plan.withColumn("base", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)))
    plan = plan.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    here, left = sizes, plan
    for digit in range(DIGITS):
        shift = (DIGITS - 1 - digit) * BITS
        if digit:
            at = left.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            here = here.join(at, here.source.eqNullSafe(at.s) & (F.shiftright(here.hash, shift + BITS) == at.p), "left_semi")
        bins = here.groupBy("source", F.shiftright("hash", shift).alias("bin")).agg(F.sum("size").alias("in_bin"))
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("in_bin").over(run))
        need = left.select(F.col("source").alias("s"), "need")
        edge = bins.join(need, bins.source.eqNullSafe(need.s)).where("upto > need").groupBy("s").agg(F.min(F.struct("bin", "upto", "in_bin")).alias("edge"))
        # no bin passes the need: everything below the last prefix's end is taken
        left = left.join(edge, left.source.eqNullSafe(edge.s), "left").select(
            "source", "source_size", "target", "base",
            F.when(F.col("edge").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("edge.upto") - F.col("edge.in_bin"))).alias("need"),
            F.when(F.col("edge").isNull(), F.shiftleft(F.col("prefix") + 1, BITS)).otherwise(F.col("edge.bin")).alias("prefix"),
            F.when(F.col("edge").isNull(), F.lit(0).cast("long")).otherwise(F.col("edge.in_bin")).alias("in_bin"),
        )
        left = stored(left, "thresholds")
    return left.select(F.col("source").alias("s"), "source_size", "target", "base", (F.col("prefix") + (2 * F.col("need") > F.col("in_bin")).cast("long")).alias("threshold"), F.lit(cap).alias("most"))


def copies(plan: DataFrame, at: Column) -> Column:
    """How often a document with the hash at is taken by its source's row of plan."""
    more = F.when((at < plan["threshold"]) & (plan["base"] < plan["most"]), 1).otherwise(0)
    return (plan["base"] + more).cast("long")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    See thresholds() for the method. Null or empty text: size 0, taken 0. Null source: a source of its own,
    the last. Null doc_id: one hash for all of them. Rows with equal doc_id share one hash and so one
    decision. An empty table gives no rows. Other columns are ignored. share above cap takes all sources to
    their cap.
    """
    sizes = sized(docs)
    plan = thresholds(sizes, share, cap, weights)
    out = sizes.join(plan, sizes.source.eqNullSafe(plan.s))
    n = copies(plan, F.col("hash"))
    return out.select("doc_id", "source", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; documents without a word go by hash too.

    Only the plan, a row per source, joins docs: the decision is a comparison of hashes where the row is.
    """
    plan = thresholds(sized(docs), share, cap, weights)
    out = docs.join(plan, docs["source"].eqNullSafe(plan["s"])).withColumn("_copies", copies(plan, hashed(docs["doc_id"]))).where("_copies > 0")
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).drop("_copy")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same thresholds by sorting: running sums in hash order, by distinct hash.
OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9) AS BIGINT) AS hash
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
  CAST([3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM per),
leveled AS (SELECT *, most / weight AS ratio,
  (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT source, source_size, coalesce(least(most, weight * (SELECT max(level) FROM leveled WHERE level <= ratio)), most) AS target FROM leveled),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM aimed),
hashes AS (SELECT source, hash, CAST(sum(size) AS BIGINT) AS in_hash FROM sized GROUP BY source, hash),
running AS (SELECT source, hash, in_hash, sum(in_hash) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) AS upto FROM hashes),
extra AS (SELECT r.source, r.hash, (r.upto <= p.target - p.base * p.source_size
    OR (r.upto - r.in_hash <= p.target - p.base * p.source_size AND 2 * (p.target - p.base * p.source_size - (r.upto - r.in_hash)) > r.in_hash)) AS more
  FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST((p.base + CASE WHEN e.more AND p.base < 2 THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.hash = e.hash
"""
