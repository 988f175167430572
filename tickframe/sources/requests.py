"""Write requests: single ones with text parameters, bulk JSON; bad rows go to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

BULK = "array<struct<name:string,labels:map<string,string>,ts:bigint,value:double>>"
_INT = r"^[+-]?[0-9]+\z"
_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"


def as_ns(text: Column) -> Column:
    """A base-10 integer without blanks, else null."""
    return F.when(text.rlike(_INT), text.try_cast("long"))


def as_value(text: Column) -> Column:
    """A number in the usual forms, NaN and infinities included, else null."""
    low = F.lower(F.regexp_replace(text, r"^\+", ""))
    word = F.when(low.isin("inf", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(low.isin("nan", "-nan"), F.lit(float("nan")))
    return F.when(text.rlike(_FLOAT), F.coalesce(word, text.try_cast("double")))


def single(requests: DataFrame) -> DataFrame:
    """name, labels, ts_ns, value, seq of requests whose name, labels, ts and value are text; unreadable ones are null."""
    return requests.select("name", L.parsed(F.coalesce("labels", F.lit(""))).alias("labels"), as_ns(F.col("ts")).alias("ts_ns"), as_value(F.col("value")).alias("value"), "seq")


def bulk(bodies: DataFrame) -> DataFrame:
    """name, labels, ts_ns, value, seq of JSON arrays in column body; bodies (seq, body) keep their order in seq.

    A body that is no such array gives one row of nulls, which validation turns away.
    """
    rows = bodies.select("seq", F.posexplode_outer(F.from_json("body", BULK)).alias("pos", "p"))
    none = F.expr("cast(map() as map<string,string>)")
    return rows.select("p.name", F.coalesce("p.labels", none).alias("labels"), F.col("p.ts").alias("ts_ns"), "p.value", (F.col("seq") * (1 << 20) + F.coalesce("pos", F.lit(0))).alias("seq"))


def validated(points: DataFrame) -> DataFrame:
    """points with trimmed label values and reason: null where a row may go in."""
    reason = (
        F.when(~L.valid_name(F.col("name")), "bad name").when(~L.valid_labels(F.col("labels")), "bad label")
        .when(F.col("ts_ns").isNull(), "bad ts").when(F.col("value").isNull(), "bad value")
    )
    return points.withColumn("reason", reason).withColumn("labels", F.when(F.col("reason").isNull(), L.trimmed_labels(F.col("labels"))).otherwise(F.col("labels")))


def accept(points: DataFrame, failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined ones (with reason). failfast: any bad row is an error and nothing goes in."""
    checked = validated(points)
    good, bad = checked.where("reason is null").drop("reason"), checked.where("reason is not null")
    if failfast and (first := bad.head(1)):
        raise ValueError(f"{first[0].reason}: {first[0].name!r}")
    return good, bad


def read_bulk_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON array each."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return bulk(files.select(F.pmod(F.xxhash64("file"), F.lit(1 << 42)).alias("seq"), F.col("value").alias("body")))
