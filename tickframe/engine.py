"""The façade: write, query, maintain, report."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .functions.timeutil import HOUR, MINUTE, duration_ns
from .metrics import Registry
from .operators import aggregate as A
from .operators import points as P
from .operators import series as S
from .sources import requests
from .sources.store import COARSE, RAW, Store


class Engine:
    """A store of points with one writer and any number of readers.

    late: reject points before the newest shard's start (as of each point's turn in seq order).
    dedup: 'last' keeps the last write per series and time over all writes, 'none' keeps all.
    """

    def __init__(self, spark: SparkSession, root: str, window: int | str = HOUR, downsample: int | str = MINUTE, max_age: int | str | timedelta = 720 * HOUR, late: bool = False, dedup: str = "last"):
        self.spark = session.apply(spark)
        self.window, self.step, self.max_age = duration_ns(window), duration_ns(downsample), duration_ns(max_age)
        self.late, self.dedup, self.metrics = late, dedup, Registry()
        self.store = Store(spark, root, self.window)

    # writing
    def ingest(self, points: DataFrame, failfast: bool = False) -> DataFrame:
        """Writes points (name, labels, ts_ns, value, seq); returns the rows turned away, with reason."""
        good, bad = requests.accept(points, failfast)
        accepted = good.persist()  # read for the series, the ids and the points
        if self.late:
            newest = self.store.blocks().agg(F.max("shard_start")).first()[0]
            judged = P.floors(good, self.window, newest if newest is not None else -(1 << 62))
            bad = bad.unionByName(judged.where(~P.on_time()).drop("floor").withColumn("reason", F.lit("late")))
            good = judged.where(P.on_time()).drop("floor")
        before = self.store.series().count()
        dim = self.store.register(good)
        rows = S.with_ids(good, dim).select("series_id", "ts_ns", "value", "seq")
        if self.dedup == "last":
            rows = P.last_write_wins(rows)
        rows = rows.select("series_id", "ts_ns", "value", "seq")
        old = self.store.version()
        self.store.write(rows)
        own = self.store.blocks(old + 1).agg(F.sum("points")).first()[0] or 0
        accepted.unpersist()
        self.metrics.count("series_registered", dim.count() - before)
        self.metrics.count("points_ingested", own - (self.store.blocks(old).agg(F.sum("points")).first()[0] or 0))
        self.metrics.count("blocks_flushed", max(0, self.store.blocks(old + 1).count() - self.store.blocks(old).count()))
        return bad

    def write(self, name: str, labels: dict[str, str], ts_ns: int, value: float, seq: int = 0) -> DataFrame:
        one = self.spark.createDataFrame([(name, labels, ts_ns, float(value), seq)], "name string, labels map<string,string>, ts_ns long, value double, seq long")
        return self.ingest(one, failfast=True)

    # reading
    def points(self, start: int, end: int, tier: str = RAW) -> DataFrame:
        rows = self.store.read(tier, start, end)
        if tier == COARSE or self.dedup != "last":
            return rows
        # all writes of a time share its shard, so the maximum per series and time stays within a shard
        return P.last_write_wins(rows, "series_id", "shard_start")

    def series_id(self, name: str, labels: dict[str, str] | None = None) -> int:
        rows = S.lookup(self.store.series(), name, labels).head(1)
        if not rows:
            raise KeyError(f"no series {name!r} with labels {labels or {}}")
        return rows[0].series_id

    def query_range(self, name: str, labels: dict[str, str] | None, start: int, end: int, agg: str = "avg", step: int | str | None = None, tier: str = RAW) -> DataFrame:
        if start > end:
            raise ValueError("the range starts after its end")
        return A.query_range(self.points(start, end, tier), [self.series_id(name, labels)], start, end, agg, step, self.window).orderBy("ts")

    def query_many(self, ids: Sequence[int], start: int, end: int, agg: str = "avg", step: int | str | None = None) -> DataFrame:
        return A.query_many(self.points(start, end), self.store.series(), ids, start, end, agg, step, self.window)

    def json(self, rows: DataFrame) -> DataFrame:
        """One JSON object per row; NaN and infinities become texts."""
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))

    # upkeep
    def compact(self) -> int:
        before = self.store.blocks().where(F.col("tier") == RAW).count()
        version = self.store.compact(self.step)
        self.metrics.count("blocks_compacted", before - self.store.blocks().where(F.col("tier") == RAW).count())
        return version

    def sweep(self, now: int) -> dict[str, int]:
        out = self.store.sweep(now, self.max_age)
        self.metrics.count("retention_sweeps")
        self.metrics.gauge("blocks_retained", out["scanned"] - out["removed"])
        return out

    def shards(self, archive_before: int | None = None, rotated: bool = False) -> DataFrame:
        """Shards with their state; rotated: the newest counts as sealed, and still takes points."""
        own = self.store.blocks().groupBy("shard_start").agg(F.sum("points").alias("points"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        return A.with_states(own, self.window, archive_before, rotated)

    def stats(self) -> DataFrame:
        return self.store.stats()

    def self_check(self, now: int) -> bool:
        """Writes a point and reads it back."""
        self.write("self.check", {}, now, 1.0)
        return self.query_range("self.check", {}, now, now + 1, "count").first().value >= 1
