"""The record log: 37-byte records in numbered segments, read and written by tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: seq, series, time and value bits (each 8 bytes, little-endian), CRC-32C of those 32, a line feed.
RECORD = 37
_POLYNOMIAL = 0x82F63B78
SCHEMA = "segment string, seq long, series_id long, ts_ns long, value double"


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


def crc32c(rows: np.ndarray) -> np.ndarray:
    """The Castagnoli CRC of each row of bytes."""
    table, crc = _table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def decoded(data: bytes) -> np.ndarray:
    """Records of fixed stride whose CRC holds; others, and a torn tail, are passed over."""
    n = len(data) // RECORD
    raw = np.frombuffer(data, np.uint8, n * RECORD).reshape(n, RECORD)
    good = raw[crc32c(raw[:, :32]) == raw[:, 32:36].copy().view("<u4")[:, 0]]
    return good[:, :32].copy().view([("seq", "<i8"), ("series_id", "<i8"), ("ts_ns", "<i8"), ("value", "<f8")])[:, 0]


def encoded(seq, series_id, ts_ns, value) -> bytes:
    raw = np.empty((len(seq), RECORD), np.uint8)
    for k, (x, t) in enumerate(((seq, "<i8"), (series_id, "<i8"), (ts_ns, "<i8"), (value, "<f8"))):
        raw[:, 8 * k : 8 * k + 8] = np.ascontiguousarray(x, t).view(np.uint8).reshape(-1, 8)
    raw[:, 32:36] = crc32c(raw[:, :32]).astype("<u4").view(np.uint8).reshape(-1, 4)
    raw[:, 36] = 10
    return raw.tobytes()


def replay(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """Records with seq >= since of all wal-*.seg files; a task decodes a segment, which has a bounded size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.seg").load(folder)

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = decoded(data)
                yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(r), pa.string()), *[pa.array(np.ascontiguousarray(r[c])) for c in r.dtype.names]], ["segment", *r.dtype.names])

    return files.select("path", "content").mapInArrow(run, SCHEMA).where(F.col("seq") >= since)


def segments(records: DataFrame, per_segment: int = (64 << 20) // RECORD) -> DataFrame:
    """segment, content: records (seq, series_id, ts_ns, value) as segments of so many, by ranges of seq."""
    rows = records.withColumn("segment", F.floor(F.col("seq") / per_segment))

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("seq")
        data = encoded(*[frame[c].to_numpy() for c in ("seq", "series_id", "ts_ns", "value")])
        return pd.DataFrame({"segment": [f"wal-{int(frame['segment'].iloc[0]):06d}.seg"], "content": [data]})

    return rows.select("segment", "seq", "series_id", "ts_ns", "value").groupBy("segment").applyInPandas(pack, "segment string, content binary")


def truncated(records: DataFrame, upto: int) -> DataFrame:
    """Records after seq upto, to be written anew by segments(); whole segments before it drop out."""
    return records.where(F.col("seq") > upto).drop("segment")


def info(records: DataFrame) -> DataFrame:
    """segments, next_seq, size of what replay() gives."""
    return records.agg(F.count_distinct("segment").alias("segments"), F.coalesce(F.max("seq") + 1, F.lit(0)).alias("next_seq"), (F.count("*") * RECORD).alias("size"))
