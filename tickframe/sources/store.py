"""The durable store: Parquet by generation and shard, under a versioned manifest.

root/series/gen=N           series rows, a generation per registering write
root/points/tier=T/gen=N/shard_start=S   points, sorted by series and time
root/manifest/version=V     a row per live block, that is (tier, generation, shard)

A write first writes its data, then the whole next manifest; readers take the newest manifest that is
complete, so they never see half a write, and a reader keeps its version while newer ones appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import HOUR, bucket, overlaps
from ..operators import aggregate as A
from ..operators import series as S

#: Points that a task writes of a shard, some 100 MB; blocks whose list is broadcast.
PART, HELD = 4_000_000, 250_000
BLOCK = "tier string, gen long, shard_start long, points long, min_ts long, max_ts long, state string"
RAW, COARSE = "raw", "downsampled"


class Store:
    def __init__(self, spark: SparkSession, root: str, window: int = HOUR):
        self.spark, self.root, self.window = spark, root.rstrip("/"), window

    # files ---------------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str, prefix: str, complete: bool) -> list[int]:
        fs, p = self._fs(f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(prefix) and (not complete or fs.exists(self._fs(f"{self.root}/{folder}/{name}/_SUCCESS")[1])):
                found.append(int(name[len(prefix) :]))
        return sorted(found)

    # manifest ------------------------------------------------------------
    def version(self) -> int:
        return max(self._numbers("manifest", "version=", True), default=0)

    def blocks(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], BLOCK)
        return self.spark.read.schema(BLOCK).parquet(f"{self.root}/manifest/version={version}")

    def _commit(self, blocks: DataFrame, old: int) -> int:
        blocks.coalesce(1).write.parquet(f"{self.root}/manifest/version={old + 1}")
        return old + 1

    def _next_gen(self) -> int:
        return 1 + max([*self._numbers(f"points/tier={RAW}", "gen=", False), *self._numbers(f"points/tier={COARSE}", "gen=", False)], default=0)

    # series --------------------------------------------------------------
    def series(self) -> DataFrame:
        gens = self._numbers("series", "gen=", True)
        if not gens:
            return S.empty(self.spark)
        return self.spark.read.schema(S.SCHEMA).parquet(*[f"{self.root}/series/gen={g}" for g in gens])

    def register(self, points: DataFrame) -> DataFrame:
        """Adds the series that points names and the store lacks; returns all series. One writer at a time."""
        fresh = S.register(points, self.series()).persist()
        if not fresh.isEmpty():
            gen = 1 + max(self._numbers("series", "gen=", False), default=0)
            fresh.write.parquet(f"{self.root}/series/gen={gen}")
        fresh.unpersist()
        return self.series()

    # points --------------------------------------------------------------
    def write(self, points: DataFrame, tier: str = RAW, drop: DataFrame | None = None) -> int:
        """Appends points (series_id, ts_ns, value, ...) as a generation, less the blocks in drop; returns the version.

        Points go to their own shard's partition. A shard is split among as many tasks as its points call for, by
        series and stretch of time, so neither a busy shard nor a busy series fills one task.
        """
        old, gen = self.version(), self._next_gen()
        path = f"{self.root}/points/tier={tier}/gen={gen}"
        points = points.withColumn("shard_start", bucket(F.col("ts_ns"), self.window))
        sizes = points.groupBy("shard_start").agg(F.ceil(F.count("*") / PART).alias("_parts"))
        part = F.pmod(F.xxhash64("series_id", bucket(F.col("ts_ns"), max(1, self.window // 16))), "_parts")
        out = points.join(sizes, "shard_start").repartition("shard_start", part).drop("_parts").sortWithinPartitions("shard_start", "series_id", "ts_ns")
        out.write.partitionBy("shard_start").parquet(path)
        written = self.spark.read.schema(out.schema).parquet(path)
        own = written.groupBy("shard_start").agg(F.count("*").alias("points"), F.min("ts_ns").alias("min_ts"), F.max("ts_ns").alias("max_ts"))
        own = own.select(F.lit(tier).alias("tier"), F.lit(gen).cast("long").alias("gen"), "shard_start", "points", "min_ts", "max_ts", F.lit("immutable").alias("state"))
        live = self.blocks(old)
        if drop is not None:
            live = live.join(drop, ["tier", "gen", "shard_start"], "left_anti")
        return self._commit(live.unionByName(own), old)

    def read(self, tier: str = RAW, start: int | None = None, end: int | None = None, version: int | None = None) -> DataFrame:
        """Points of the live blocks; with a range, of the shards that meet it (partition pruning) and in it."""
        blocks = self.blocks(version).where(F.col("tier") == tier)
        if start is not None:
            blocks = blocks.where(overlaps(F.col("shard_start"), self.window, start, end))
        gens = [r.gen for r in blocks.select("gen").distinct().collect()]
        schema = "series_id long, ts_ns long, value double, seq long" if tier == RAW else "series_id long, ts_ns long, value double, sum double, count long, min double, max double"
        if not gens:
            return self.spark.createDataFrame([], schema + ", shard_start long")
        base = f"{self.root}/points/tier={tier}"
        rows = self.spark.read.schema(schema + ", gen long, shard_start long").option("basePath", base).parquet(*[f"{base}/gen={g}" for g in sorted(gens)])
        if start is not None:
            rows = A.in_range(rows, start, end, self.window)
        live = blocks.select("gen", "shard_start")
        if live.count() <= HELD:
            live = F.broadcast(live)
        return rows.join(live, ["gen", "shard_start"], "left_semi").drop("gen")

    # upkeep --------------------------------------------------------------
    def sealed(self, blocks: DataFrame) -> DataFrame:
        newest = blocks.agg(F.max("shard_start").alias("newest"))
        return blocks.crossJoin(F.broadcast(newest)).where("shard_start < newest").drop("newest")

    def compact(self, step: int, every: bool = False) -> int:
        """Downsamples raw blocks of sealed shards (or all): one row per series and bucket over all of a shard's blocks.

        The coarse generation and the removal of its raw blocks are one manifest.
        """
        from ..operators.points import last_write_wins

        blocks = self.blocks().where(F.col("tier") == RAW)
        old = (blocks if every else self.sealed(blocks)).select("tier", "gen", "shard_start")
        shards = old.select("shard_start").distinct()
        rows = self.read(RAW).join(shards, "shard_start", "left_semi")
        if old.isEmpty():
            return self.version()
        return self.write(A.downsample(last_write_wins(rows), step), COARSE, old)

    def sweep(self, now: int, max_age: int) -> dict[str, int]:
        """Removes blocks whose newest point is max_age old or older; counts blocks seen and removed."""
        old, blocks = self.version(), self.blocks()
        keep = blocks.where(F.col("max_ts") > now - max_age)
        scanned, kept = blocks.count(), keep.count()
        if kept < scanned:
            self._commit(keep, old)
        return {"scanned": scanned, "removed": scanned - kept}

    def reclaim(self, keep_versions: int = 1) -> int:
        """Deletes manifests but the newest and generations that no kept manifest names; returns folders deleted."""
        versions = self._numbers("manifest", "version=", True)
        kept, gone = versions[-keep_versions:], versions[:-keep_versions]
        live = {(r.tier, r.gen) for v in kept for r in self.blocks(v).select("tier", "gen").distinct().collect()}
        paths = [f"manifest/version={v}" for v in gone]
        for tier in (RAW, COARSE):
            paths += [f"points/tier={tier}/gen={g}" for g in self._numbers(f"points/tier={tier}", "gen=", False) if (tier, g) not in live]
        for p in paths:
            fs, path = self._fs(f"{self.root}/{p}")
            fs.delete(path, True)
        return len(paths)

    def stats(self) -> DataFrame:
        """shards, blocks, series, points, min_ts, max_ts."""
        own = self.blocks().agg(F.count_distinct("shard_start").alias("shards"), F.count("*").alias("blocks"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
        return own.crossJoin(S.cardinality(self.series()))
