"""Range queries: tumbling buckets with avg, sum, min, max, count, delta; downsampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import bucket, duration_ns, overlaps, step_ns

AGGREGATES = ("avg", "sum", "min", "max", "count", "delta")


def in_range(points: DataFrame, start: int, end: int, window: int | None = None) -> DataFrame:
    """Points in [start, end); with the shard width also as a bound on shard_start, which prunes partitions."""
    if start > end:
        raise ValueError("the range starts after its end")
    out = points.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end))
    return out.where(overlaps(F.col("shard_start"), window, start, end)) if window else out


def _first_sticky(pick: str) -> Column:
    """Minimum or maximum in time order where a first NaN stays and later ones are passed over."""
    rows = F.array_sort(F.collect_list(F.struct("ts_ns", "value")))
    better = (lambda a, v: v < a) if pick == "min" else (lambda a, v: v > a)

    def fold(a, x):
        v = x["value"]
        # Spark orders NaN above all numbers; plain comparison with NaN is false
        return F.when(a.isNull(), v).when(F.isnan(a) | F.isnan(v), a).when(better(a, v), v).otherwise(a)

    return F.aggregate(rows, F.lit(None).cast("double"), fold)


def _value(agg: str, nan: str) -> Column:
    if agg in ("min", "max") and nan == "first_sticky":
        return _first_sticky(agg)
    return {"sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("*").cast("double")}.get(agg, F.avg("value"))


def aggregate(points: DataFrame, agg: str = "avg", step: int | str | None = None, keys: Sequence[str] = ("series_id",), strict: bool = False, nan: str = "spark") -> DataFrame:
    """keys, ts, value, count per bucket that holds a point, in one shuffle on keys and bucket.

    Buckets start at multiples of step, so the first may start before the range. An unknown agg means avg,
    or raises where strict. delta is the difference from the bucket before, the first bucket keeps its own.
    """
    if strict and agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    out = points.groupBy(*keys, bucket(F.col("ts_ns"), step_ns(step)).alias("ts")).agg(_value(agg, nan).alias("value"), F.count("*").alias("count"))
    return delta(out, keys) if agg == "delta" else out


def delta(buckets: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    before = F.lag("value", 1, 0.0).over(Window.partitionBy(*keys).orderBy("ts"))
    return buckets.withColumn("value", F.col("value") - before)


def query_range(points: DataFrame, ids: Sequence[int], start: int, end: int, agg: str = "avg", step: int | str | None = None, window: int | None = None, **options) -> DataFrame:
    """series_id, ts, value, count of the given series in [start, end): filter, then buckets, then delta."""
    chosen = in_range(points, start, end, window).where(F.col("series_id").isin(list(ids)))
    return aggregate(chosen, agg, step, **options)


def query_many(points: DataFrame, series: DataFrame, ids: Sequence[int], start: int, end: int, agg: str = "avg", step: int | str | None = None, window: int | None = None) -> DataFrame:
    """pos, series_id, name, results in the order asked; ids may repeat, unknown ones have no results."""
    spark = points.sparkSession
    asked = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, series_id long")
    rows = query_range(points, sorted(set(ids)), start, end, agg, step, window)
    nested = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value", "count"))).alias("results"))
    out = asked.join(nested, "series_id", "left").join(series.select("series_id", "name"), "series_id", "left")
    none = F.array().cast("array<struct<ts:long,value:double,count:long>>")
    return out.select("pos", "series_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("results", none).alias("results")).orderBy("pos")


def downsample(points: DataFrame, step: int | str | None = None, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """A point per series and bucket with the average, and sum, count, min, max for exact re-aggregation."""
    out = points.groupBy(*keys, bucket(F.col("ts_ns"), step_ns(step)).alias("ts_ns"))
    return out.agg(F.avg("value").alias("value"), F.sum("value").alias("sum"), F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))


def reaggregate(rows: DataFrame, agg: str, step: int | str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Buckets of downsampled rows as over the raw points, from the stored sums and counts (step a multiple of theirs)."""
    value = {"sum": F.sum("sum"), "min": F.min("min"), "max": F.max("max"), "count": F.sum("count").cast("double")}.get(agg, F.sum("sum") / F.sum("count"))
    return rows.groupBy(*keys, bucket(F.col("ts_ns"), duration_ns(step)).alias("ts")).agg(value.alias("value"), F.sum("count").alias("count"))


def shards(points: DataFrame, window: int, archive_before: int | None = None, rotated: bool = False) -> DataFrame:
    """shard_start, shard_end, points, min_ts, max_ts, state.

    All but the newest shard are sealed, and the newest too once rotated. Sealed shards that end at
    archive_before or earlier are archived.
    """
    own = points.groupBy(bucket(F.col("ts_ns"), window).alias("shard_start")).agg(F.count("*").alias("points"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))
    return with_states(own, window, archive_before, rotated)


def with_states(own: DataFrame, window: int, archive_before: int | None = None, rotated: bool = False) -> DataFrame:
    newest = own.agg(F.max("shard_start").alias("newest"))
    end = F.col("shard_start") + window
    sealed = (F.col("shard_start") < F.col("newest")) | F.lit(rotated)
    state = F.when(sealed & (end <= F.lit(archive_before)), "archived").when(sealed, "sealed").otherwise("active")
    return own.crossJoin(F.broadcast(newest)).select("shard_start", end.alias("shard_end"), "points", "min_ts", "max_ts", state.alias("state"))


def shard_counts(shards_: DataFrame) -> DataFrame:
    """shards, active, sealed, archived."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return shards_.agg(F.count("*").alias("shards"), state("active"), state("sealed"), state("archived"))
