"""Cutting rows into ranges of about equal numbers, for ranks and running values in two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range at least, and ranges at most: of each range one row meets the others in one task.
ROWS, RANGES = 1 << 16, 4096


def range_of(rows: DataFrame, column: str, at_least: int = ROWS, parts: int | None = None) -> Column:
    """The number of a row's range of column, rising with it; bounds are quantiles, so uneven values make even ranges.

    There are as many ranges as the number of rows calls for, or parts of them.
    """
    parts = parts or min(RANGES, -(-rows.count() // at_least))
    if parts <= 1:
        return F.lit(0)
    cuts = sorted(set(rows.approxQuantile(column, [k / parts for k in range(1, parts)], 1 / (4 * parts))))
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(column).cast("double")))


def numbered(rows: DataFrame, name: str, first: str, *then: str, at_least: int = ROWS) -> DataFrame:
    """rows with name, their rank from 1 by first and then the other columns; no task sees all rows."""
    rows = rows.withColumn("_range", range_of(rows, first, at_least))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(first, *then))
    return rows.withColumn("_rank", rank).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_before")
