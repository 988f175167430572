"""Session settings that the engine relies on, all settable at run time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def apply(spark: SparkSession) -> SparkSession:
    """UTC, and the last of equal label keys wins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tickframe-{name}-{uuid.uuid4().hex}"
