"""The late rule on a stream: a floor that rises with the newest shard, kept as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.timeutil import bucket
from ..operators import points as P

OUT = "series_id long, ts_ns long, value double, seq long, accepted boolean"


def judged(frame: pd.DataFrame, window: int, floor: int) -> tuple[pd.DataFrame, int]:
    """frame in seq order with accepted, and the floor after it. Accepted points alone raise the floor, and a
    rejected one lies below it, so the floor is that of the running maximum of all times."""
    frame = frame.sort_values("seq", kind="stable")
    newest = frame["ts_ns"].cummax()
    start = newest - newest.abs() % window * newest.map(lambda v: 1 if v >= 0 else -1)
    floors = start.clip(lower=floor)
    before = floors.shift(1, fill_value=floor)
    out = frame.assign(accepted=frame["ts_ns"] >= before)
    return out, int(floors.iloc[-1]) if len(floors) else floor


class LateRule(StatefulProcessor):
    """One state per group; the rule is over all series of a group, so a group is a stream of its own order."""

    def __init__(self, window: int, first_floor: int):
        self.window, self.first_floor = window, first_floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.floor = handle.getValueState("floor", "floor long")

    def handleInputRows(self, key, rows, timerValues):
        floor = self.floor.get()[0] if self.floor.exists() else self.first_floor
        # the order within a micro-batch is that of seq, so its chunks come together first
        frame = pd.concat(list(rows))
        out, floor = judged(frame, self.window, floor)
        self.floor.update((floor,))
        yield out[["series_id", "ts_ns", "value", "seq", "accepted"]]

    def close(self) -> None:
        pass


def late_rule(points: DataFrame, window: int, first_floor: int, group: str | None = None) -> DataFrame:
    """points (series_id, ts_ns, value, seq) of a stream with accepted.

    Without group the rule is global, as one order over all series demands: one state and one task. With a
    column (a tenant, say) each of its values has its own floor, and groups run in parallel.
    """
    key = F.lit(0) if group is None else F.col(group)
    return points.withColumn("_group", key).groupBy("_group").transformWithStateInPandas(LateRule(window, first_floor), OUT, "append", "None")


def judge(stream: DataFrame, folder: str, checkpoint: str, window: int, first_floor: int) -> StreamingQuery:
    """The global rule over what stream has now: its points with accepted, as Parquet in folder, by micro-batch.

    Micro-batches follow one another in seq order. Inside one, floors() takes the running maximum in two steps, so
    no task sees a whole micro-batch; only the newest floor, one number, goes on to the next. It is kept by batch id
    in the checkpoint folder and each batch's rows replace those of its own id, so a batch run again agrees.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, floor = batch.sparkSession, first_floor
        if batch_id:
            floor = spark.read.schema("floor long").parquet(f"{checkpoint}/floors/{batch_id - 1}").first().floor
        out = P.floors(batch, window, floor).withColumn("accepted", P.on_time())
        out.select("series_id", "ts_ns", "value", "seq", "accepted").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        newest = batch.agg(F.greatest(bucket(F.max("ts_ns"), window), F.lit(floor)).alias("floor"))
        newest.write.mode("overwrite").parquet(f"{checkpoint}/floors/{batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
