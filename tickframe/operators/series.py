"""The series dimension: registering, looking up, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .ranges import numbered

SCHEMA = "series_id long, name string, labels map<string,string>"


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def unregistered(points: DataFrame, series: DataFrame) -> DataFrame:
    """(name, labels) of points (name, labels, seq) that series lacks, with the first seq of each."""
    fresh = points.select("name", L.key(F.col("labels")).alias("k"), "seq").groupBy("name", "k").agg(F.min("seq").alias("first_seq"))
    known = series.select("name", L.key(F.col("labels")).alias("k"))
    return fresh.join(known, ["name", "k"], "left_anti")


def register(points: DataFrame, series: DataFrame) -> DataFrame:
    """Rows to append to series: ids go on from the largest in the order of the first seq (one writer at a time).

    New series are numbered in two steps, by ranges of their first seq and inside them, so a first load of very
    many series does not meet in one task.
    """
    last = series.agg(F.coalesce(F.max("series_id"), F.lit(0)).alias("last"))
    fresh = numbered(unregistered(points, series), "n", "first_seq", "name", "k").crossJoin(F.broadcast(last))
    return fresh.select((F.col("last") + F.col("n")).cast("long").alias("series_id"), "name", F.map_from_entries("k").alias("labels"))


def with_ids(points: DataFrame, series: DataFrame) -> DataFrame:
    """points (name, labels, ...) with series_id in place of name and labels; unknown series drop out."""
    points = points.withColumn("_k", L.key(F.col("labels")))
    dim = series.select("series_id", F.col("name").alias("_name"), L.key(F.col("labels")).alias("_key"))
    out = points.join(dim, (points["name"] == dim["_name"]) & (points["_k"] == dim["_key"]))
    return out.drop("name", "labels", "_k", "_name", "_key")


def lookup(series: DataFrame, name: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The series of exactly this name and these labels: values are matched as given, not trimmed."""
    spark = series.sparkSession
    wanted = spark.createDataFrame([(name, dict(labels or {}))], "name string, labels map<string,string>").select("name", L.key(F.col("labels")).alias("_key"))
    return series.withColumn("_key", L.key(F.col("labels"))).where(F.col("name") == name).join(F.broadcast(wanted), ["name", "_key"], "left_semi").drop("_key")


def names_of(ids: DataFrame, series: DataFrame) -> DataFrame:
    """ids (series_id, ...) with name; an unknown id has the empty name."""
    return ids.join(series.select("series_id", "name"), "series_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def cardinality(series: DataFrame) -> DataFrame:
    return series.agg(F.count("*").alias("series"))
