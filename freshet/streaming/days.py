"""Days of stations kept as a stream: late readings change days that were told before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_SHAPE = "station string, date date, t_mean double, t_min double, t_max double, n_hours int, status string"
_EPOCH = np.datetime64("1970-01-01")


class _Days(StatefulProcessor):
    """Of each station a row of state per day: 24 hours with sum, count, least, greatest, and whether every reading was final."""

    def __init__(self, min_hours: int, keep_days: int):
        self.min_hours, self.keep_days = min_hours, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day int", "hours binary")
        self.newest = handle.getValueState("newest", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        touched: dict[int, np.ndarray] = {}
        for frame in rows:
            newest = max(int(frame["hour"].max()) // 24, -(1 << 30) if newest is None else newest)
            for hour, n, total, low, high, final in frame.groupby("hour").agg(n=("value", "size"), total=("value", "sum"), low=("value", "min"), high=("value", "max"), final=("final", "min")).itertuples():
                day, at = divmod(int(hour), 24)
                if day not in touched:
                    known = self.days.getValue((day,)) if self.days.containsKey((day,)) else None
                    touched[day] = np.frombuffer(known[0]).reshape(24, 5).copy() if known else np.array([[0.0, 0.0, np.inf, -np.inf, 1.0]] * 24)
                held = touched[day][at]
                touched[day][at] = (held[0] + total, held[1] + n, min(held[2], low), max(held[3], high), min(held[4], float(final)))
        out = []
        for day in sorted(touched):
            if day <= newest - self.keep_days:
                continue  # too late: the day is closed
            state = touched[day]
            self.days.updateValue((day,), (state.tobytes(),))
            seen = state[state[:, 1] > 0]
            if len(seen) >= self.min_hours:
                out.append((str(key[0]), (_EPOCH + day).item(), float((seen[:, 0] / seen[:, 1]).mean()), float(seen[:, 2].min()), float(seen[:, 3].max()), len(seen), "approved" if seen[:, 4].min() == 1 else "provisional"))
        if newest is not None:
            self.newest.update((newest,))
            for (day,) in list(self.days.keys()):
                if day <= newest - self.keep_days:
                    self.days.removeKey((day,))
        if out:
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in _SHAPE.split(",")])

    def close(self) -> None:
        pass


def days(readings: DataFrame, low: float = -1.0, high: float = 35.0, min_hours: int = 20, offset: int = -8 * 3600, keep_days: int = 60) -> DataFrame:
    """A stream of days, each told again whenever a reading changes it: what ``readings_to_days`` gives for the readings so far.

    ``readings``: station, ts, value, final[, offset_s]. A late provisional reading makes an approved day provisional again. Readings of days
    ``keep_days`` or more before the station's newest are too late; their state is gone, so a station holds that many
    rows of state at most. Runs on the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    shift = F.coalesce(F.col("offset_s"), F.lit(offset)) if "offset_s" in readings.columns else F.lit(offset)
    kept = readings.where(F.col("value").between(low, high) & F.col("station").isNotNull() & F.col("ts").isNotNull())
    hours = kept.select(F.col("station").cast("string").alias("station"), F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + shift) / 3600).alias("hour"), "value", F.coalesce("final", F.lit(False)).alias("final"))
    return hours.groupBy("station").transformWithStateInPandas(_Days(min_hours, keep_days), _SHAPE, "update", "none")


def start(told: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch tells below ``path``, by batch: a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return told.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each station's days as they were told last."""
    told = spark.read.schema(_SHAPE + ", batch long").option("basePath", path).parquet(path)
    last = Window.partitionBy("station", "date")
    return told.withColumn("_last", F.max("batch").over(last)).where("batch = _last").drop("_last", "batch")
