"""Counters and gauges on the driver, and their text form as a DataFrame."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """Named int64 metrics, created when first used; a name is a counter or a gauge, never both."""

    def __init__(self) -> None:
        self._lock, self._values, self._kinds = threading.Lock(), {}, {}

    def _at(self, name: str, kind: str, change) -> int:
        with self._lock:
            if self._kinds.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is a {self._kinds[name]}")
            self._values[name] = change(self._values.get(name, 0))
            return self._values[name]

    def count(self, name: str, by: int = 1) -> int:
        return self._at(name, "counter", lambda v: v + by)

    def gauge(self, name: str, value: int) -> int:
        return self._at(name, "gauge", lambda _: value)

    def add(self, name: str, by: int) -> int:
        return self._at(name, "gauge", lambda v: v + by)

    def values(self) -> dict[str, int]:
        with self._lock:
            return dict(self._values)

    def lines(self, spark: SparkSession) -> DataFrame:
        return text_lines(spark.createDataFrame(sorted(self.values().items()), "name string, value long"))


def text_lines(metrics: DataFrame) -> DataFrame:
    """'name value' per row of metrics (name, value), by name."""
    return metrics.orderBy("name").select(F.concat_ws(" ", "name", F.col("value").cast("string")).alias("line"))
