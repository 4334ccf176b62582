"""Anchored alert dedup on a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.operators.alerts import DEDUP_KEY, dedup_alerts
from netloom.session import use_disk_state
from netloom.streaming.buckets import TimeBuckets, read_state, waiting_rows

BUCKETS = 4  # time buckets to a window
_ANCHOR = "anchor_us long, anchor_id long"


class DedupProcessor(StatefulProcessor):
    """State per key: alerts the watermark has not passed, by time bucket, and the open window's anchor.

    The anchor is dropped by a timer once its window is over, so idle keys hold no state.
    """

    def __init__(self, window_s: float, schema: T.StructType, key: Sequence[str], rid: str):
        self.window_us = round(max(1.0, window_s) * 1_000_000)
        self.schema, self.key, self.names = schema, list(key), schema.names
        self.us, self.rid = self.names.index("event_us"), self.names.index(rid)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = TimeBuckets(handle, self.schema, self.window_us // BUCKETS, self.us)
        self.anchor = handle.getValueState("anchor", _ANCHOR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.add(pdf[self.names].itertuples(index=False, name=None))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._advance(timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "is_first", "anchor_us", "anchor_id"]).convert_dtypes()

    def close(self) -> None:
        pass

    def _advance(self, clock_ms: int) -> list[tuple]:
        before = anchor = tuple(self.anchor.get()) if self.anchor.exists() else None
        out = []
        for r in sorted(self.waiting.take(clock_ms), key=lambda r: (r[self.us], r[self.rid])):
            first = anchor is None or r[self.us] - anchor[0] >= self.window_us
            if first:
                anchor = (r[self.us], r[self.rid])
            out.append((*r, first, *anchor))
        if anchor is not None and self.waiting.passed(clock_ms) >= anchor[0] + self.window_us:
            self.anchor.clear()
        elif anchor != before:
            self.anchor.update(anchor)
            self.waiting.wake(anchor[0] + self.window_us)
        return out


def dedup_stream(
    alerts: DataFrame, window_s: float = 60.0, *, ts: str = "ts", rid: str = "flow_id",
    key: Sequence[str] = DEDUP_KEY, delay: str = "10 seconds",
) -> DataFrame:
    """Alerts with ``is_first`` and their window's anchor, emitted once the watermark passes.

    Spark's own watermark dedup is no substitute: its windows follow the watermark, not
    the first alert.
    """
    use_disk_state(alerts.sparkSession)
    rows = alerts.withWatermark(ts, delay).withColumn("event_us", F.unix_micros(ts))
    kept = [f for f in rows.schema if f.name != ts]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    out_schema = T.StructType(
        list(schema)
        + [T.StructField("is_first", T.BooleanType()), T.StructField("anchor_us", T.LongType()), T.StructField("anchor_id", T.LongType())]
    )
    out = rows.groupBy(*key).transformWithStateInPandas(
        DedupProcessor(window_s, schema, key, rid), out_schema, outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn(ts, F.timestamp_micros("event_us")).drop("event_us")


def flush_waiting_alerts(spark: SparkSession, checkpoint: str, window_s: float = 60.0, *, ts: str = "ts", rid: str = "flow_id",
                         key: Sequence[str] = DEDUP_KEY, more: DataFrame | None = None) -> DataFrame:
    """End of stream: decide the alerts that still wait (and ``more`` of them), given the windows left open."""
    held = read_state(spark, checkpoint, "anchor")
    value = [f.name for f in held.schema if f.name not in ("key", "partition_id")][0]
    waiting = waiting_rows(spark, checkpoint).drop("key")
    if more is not None:
        waiting = waiting.unionByName(more.withColumn("event_us", F.unix_micros(ts)).select(waiting.columns))
    opened = held.select(
        *(F.col(f"key.{k}").alias(k) for k in key),
        F.col(f"{value}.anchor_us").alias("event_us"), F.col(f"{value}.anchor_id").alias(rid), F.lit(True).alias("_open"),
    )
    rows = waiting.withColumn("_open", F.lit(False)).unionByName(opened, allowMissingColumns=True)
    rows = rows.withColumn(ts, F.timestamp_micros("event_us"))
    return dedup_alerts(rows, window_s, key=key, ts=ts, rid=rid).where(~F.col("_open")).drop("_open", "event_us")
