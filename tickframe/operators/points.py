"""Points: last write wins, and the rule for late ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import bucket
from .ranges import range_of

SCHEMA = "series_id long, ts_ns long, value double, seq long"


def last_write_wins(points: DataFrame, *keys: str) -> DataFrame:
    """One point per series (or keys) and time: that with the largest seq. Partial maxima combine before the shuffle."""
    keys = keys or ("series_id",)
    return points.groupBy(*keys, "ts_ns").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def floors(points: DataFrame, window: int, first_floor: int, chunks: int | None = None) -> DataFrame:
    """points with floor, the start of the newest shard before each, in seq order over all series.

    The running maximum is taken in two steps, so no task sees all points: seq is cut in ranges, each range's
    maximum runs over the few ranges, and points run over their own range from the maximum before it. The number of
    ranges follows that of points (or is chunks), their bounds are quantiles of seq.
    """
    points = points.withColumn("_range", range_of(points, "seq", parts=chunks))
    top = points.groupBy("_range").agg(F.max("ts_ns").alias("_top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_before", F.max("_top").over(before)).drop("_top")
    own = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("_own", F.max("ts_ns").over(own)).join(F.broadcast(top), "_range")
    newest = F.greatest(F.col("_own"), F.col("_before"))
    floor = F.greatest(F.coalesce(bucket(newest, window), F.lit(first_floor)), F.lit(first_floor))
    return points.withColumn("floor", floor).drop("_range", "_own", "_before")


def on_time() -> Column:
    return F.col("ts_ns") >= F.col("floor")
