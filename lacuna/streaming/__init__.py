"""Structured Streaming over event series: windowed and session summaries, carried-forward values, gap alarms, into files with a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int | None = None, glob: str = "events*.parquet") -> DataFrame:
    """Events as a stream, ``ts`` as a zoned timestamp (watermarks need one)."""
    r = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_summary(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Count, mean and range per window and type; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def session_summary(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Carry(StatefulProcessor):
    """The newest observed value and the newest time of a user, dropped after ``ttl`` milliseconds without an update, if given."""

    def __init__(self, value: str, late: float, ttl: int | None):
        self.value, self.late, self.ttl = value, late, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double, micros long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["micros", "event_id"], ignore_index=True)
        value, newest = self.last.get() if self.last.exists() else (None, None)
        late = f["micros"] < (newest - self.late * 1e6) if newest is not None else pd.Series(False, index=f.index)
        x = f[self.value].where(~late).ffill()
        if value is not None:
            x = x.fillna(value)
        x = x.where(~late, f[self.value])
        if (~late).any():
            known = x[~late].dropna()
            self.last.update((float(known.iloc[-1]) if len(known) else value, int(max(f["micros"].max(), newest or f["micros"].max()))))
        yield pd.DataFrame({"user_id": key[0], "event_id": f["event_id"], "micros": f["micros"], "imputed": x, "late": late})

    def close(self) -> None:
        pass


def carry_forward(events: DataFrame, value: str = "obs", late: float = 2 * 86400.0, ttl_days: int | None = None) -> DataFrame:
    """``(user_id, event_id, ts, imputed, late)``: the last observation carried forward per user, across batches. The state is two numbers a user. With ``ttl_days``
    it is dropped after so many days without events, so users who never come back cost nothing; that counts processing time, so such a stream has always something
    to do and must run by a trigger interval, not to the end of its input.

    A row over ``late`` seconds older than its user's newest is marked, keeps its own value and changes no state: its place in the order has been passed. Null
    users are one group; rows without a time go. Needs a state store with columns (``run_to_files`` sets it).
    """
    slim = events.where("ts IS NOT NULL").select("user_id", "event_id", F.unix_micros("ts").alias("micros"), F.col(value).cast("double").alias(value))
    out = slim.groupBy("user_id").transformWithStateInPandas(
        _Carry(value, late, ttl_days and ttl_days * 86_400_000), "user_id long, event_id long, micros long, imputed double, late boolean", "Append", "ProcessingTime" if ttl_days else "None")
    return out.select("user_id", "event_id", F.timestamp_micros("micros").alias("ts"), "imputed", "late")


class _Alarms(StatefulProcessor):
    """The newest time of a user, and a timer where its silence becomes a gap."""

    def __init__(self, gap: float):
        self.gap = round(gap * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _row(self, key, start: list[int], end: list[int | None]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(start), "start_ms": start, "end_ms": pd.array(end, dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(m) for f in rows for m in f["ms"])
        old = int(self.last.get()[0]) if self.last.exists() else None
        newest = max(times[-1], old if old is not None else times[-1])
        if old is not None:
            times = [old, *[t for t in times if t >= old]]
        gaps = [(a, b) for a, b in zip(times, times[1:]) if b - a > self.gap]
        self.last.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.gap)
        yield self._row(key, [a for a, _ in gaps], [b for _, b in gaps])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield self._row(key, [last], [None])

    def close(self) -> None:
        pass


def gap_alarms(events: DataFrame, gap: float = 3 * 86400.0, late: str = "2 days") -> DataFrame:
    """``(user_id, start, end)``: silences of over ``gap`` seconds between a user's events, and, with a null end, those that the watermark has
    passed without a further event: an event-time timer raises them once, and drops the user's state.

    Times count in whole milliseconds. Events behind the watermark come too late to be heard and go; so do rows without a time. Of a batch all events are
    sorted in memory: a user's events of one batch.
    """
    slim = events.where("ts IS NOT NULL").withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    out = slim.groupBy("user_id").transformWithStateInPandas(_Alarms(gap), "user_id long, start_ms long, end_ms long", "Append", "EventTime")
    return out.select("user_id", F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"))


def run_to_files(df: DataFrame, output: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()) -> DataFrame:
    """Drives a bounded stream to its end into Parquet files and reads them back; a run with the same checkpoint goes on where the last one ended.

    ``append``: Spark's file sink, each row once. ``complete``: every batch replaces the files by the whole result. Partition columns, such as ``late``, make
    folders of their own. The session's state store setting is put back as it was.
    """
    spark = df.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "complete":
            w = w.foreachBatch(lambda rows, _: rows.write.mode("overwrite").partitionBy(*partition_by).parquet(output))
        else:
            w = w.format("parquet").option("path", output)
            w = w.partitionBy(*partition_by) if partition_by else w
        query = w.start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(df.schema).parquet(output)
