"""Streams into the store, and windowed aggregates of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

POINTS = "name string, labels map<string,string>, ts_ns long, value double, seq long"


def files(spark: SparkSession, folder: str, per_trigger: int | None = None, schema: str = POINTS) -> DataFrame:
    """A stream of Parquet files as they appear; per_trigger bounds a micro-batch, which is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(folder)


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Writes each micro-batch by engine.ingest: batches follow one another, so there is one writer.

    A batch that is run again after a failure writes its points again; the last write per series, time and
    seq wins, so the result is the same.
    """
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.ingest(batch) and None)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime=every)).start()


def windowed(stream: DataFrame, step: str, delay: str) -> DataFrame:
    """name, ts (bucket start, ns), value (average), count per closed window of a stream, for times from 0 on."""
    timed = stream.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", delay)
    out = timed.groupBy(F.window("at", step), "name").agg(F.avg("value").alias("value"), F.count("*").alias("count"))
    return out.select("name", (F.unix_micros("window.start") * 1000).alias("ts"), "value", "count")
