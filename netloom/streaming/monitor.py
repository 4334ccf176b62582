"""Monitoring on streams: windowed counters and rules, silent sources, and rows that came too late.

Windows are final when the watermark has passed them (append mode), so a sink that keeps one folder per batch
(:func:`netloom.streaming.detect.write_once`) holds every window once, also after a replay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from netloom.operators import metrics, traffic
from netloom.session import use_disk_state


def counters_stream(predictions: DataFrame, window: str, delay: str = "10 seconds", ts: str = "ts", high: float = 0.85) -> DataFrame:
    """:func:`traffic_counters` of every closed window."""
    return traffic.traffic_counters(predictions.withWatermark(ts, delay), window, ts, high)


def increase_stream(
    events: DataFrame, window: str = "1 minute", slide: str = "5 seconds", where: str | Column = "true", delay: str = "10 seconds",
    ts: str = "ts", by: Sequence[str] = (),
) -> DataFrame:
    """Matching events in the window that ends at each evaluation time, once that time has passed.

    The watermark follows all events, so windows close while nothing matches.
    """
    marked = events.withWatermark(ts, delay)
    hit = F.expr(where) if isinstance(where, str) else where
    out = marked.groupBy(*by, F.window(ts, window, slide).alias("w")).agg(F.count(F.when(hit, 1)).alias("increase"))
    return out.where("increase > 0").select(*by, F.col("w.end").alias("ts"), "increase")


def ratio_stream(events: DataFrame, part: str | Column, window: str, delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """:func:`windowed_ratio` of every closed window."""
    return metrics.windowed_ratio(events.withWatermark(ts, delay), part, window, ts)


def average_stream(events: DataFrame, value: str, window: str, delay: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """:func:`windowed_average` of every closed window."""
    return metrics.windowed_average(events.withWatermark(ts, delay), value, window, ts)


class HoldProcessor(StatefulProcessor):
    """The interval in which a condition holds: one state of three numbers per rule.

    Emits ``firing`` when the hold time is reached and ``resolved`` when such an interval ends: on a false
    evaluation, or when one is missing.
    """

    def __init__(self, seconds: float, step_s: float):
        self.hold, self.step = round(seconds * 1_000_000), round(step_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.interval = handle.getValueState("interval", "started long, last long, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(us), bool(c)) for pdf in rows for us, c in zip(pdf["us"], pdf["cond"], strict=True))
        own = tuple(self.interval.get()) if self.interval.exists() else None
        out = []
        for us, cond in new:
            if own and (not cond or us - own[1] > self.step):
                out += self._end(key, own)
                own = None
            if cond:
                started, fired = (own[0], own[2]) if own else (us, False)
                if not fired and us - started >= self.hold:
                    out.append((*key, "firing", started, started + self.hold, None))
                    fired = True
                own = (started, us, fired)
        yield from self._keep(own, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = tuple(self.interval.get()) if self.interval.exists() else None
        if own and self._late(own) <= timerValues.getCurrentWatermarkInMs():
            yield from self._keep(None, self._end(key, own))

    def close(self) -> None:
        pass

    def _late(self, own: tuple) -> int:
        """When the evaluation after the last one must have come: its window is closed, and one more for its way."""
        return (own[1] + 3 * self.step) // 1000

    def _end(self, key: tuple, own: tuple) -> list[tuple]:
        return [(*key, "resolved", own[0], own[0] + self.hold, own[1])] if own[2] else []

    def _keep(self, own: tuple | None, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if own:
            self.interval.update(own)
            self.handle.registerTimer(self._late(own))
        else:
            self.interval.clear()
        if out:
            names = [*(f"k{i}" for i in range(len(out[0]) - 4)), "event", "started_us", "fired_us", "ended_us"]
            yield pd.DataFrame(out, columns=names).convert_dtypes()


def hold_stream(evaluations: DataFrame, seconds: float, step_s: float, rule: str, cond: str = "cond", ts: str = "ts") -> DataFrame:
    """``rule, event, started_us, fired_us, ended_us`` of a rule whose closed windows carry a condition.

    ``event`` is ``firing`` (``ended_us`` still unknown) or ``resolved``.  An evaluation per ``step_s`` is expected.
    """
    use_disk_state(evaluations.sparkSession)
    rows = evaluations.select(F.lit(rule).alias("rule"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.coalesce(cond, F.lit(False)).alias("cond"))
    schema = "k0 string, event string, started_us long, fired_us long, ended_us long"
    out = rows.groupBy("rule").transformWithStateInPandas(HoldProcessor(seconds, step_s), schema, outputMode="Append", timeMode="EventTime")
    return out.withColumnRenamed("k0", "rule")


class SilenceProcessor(StatefulProcessor):
    """A timer of the wall clock per source: it fires once when heartbeats stop, and the next one is a recovery."""

    def __init__(self, seconds: float):
        self.limit = round(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "seen_ms long, silent boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        seen, silent = self.beat.get() if self.beat.exists() else (now, False)
        self.beat.update((now, False))
        self.handle.registerTimer(now + self.limit)
        if silent:
            yield self._event(key, "recovered", seen, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen, silent = self.beat.get() if self.beat.exists() else (now, True)
        # Timers of earlier heartbeats come too; only the one after the last counts.
        if not silent and now - seen >= self.limit:
            self.beat.update((seen, True))
            yield self._event(key, "silent", seen, now)

    def close(self) -> None:
        pass

    def _event(self, key: tuple, event: str, seen: int, now: int) -> pd.DataFrame:
        return pd.DataFrame([(*key, event, seen, now)], columns=[*(f"k{i}" for i in range(len(key))), "event", "seen_ms", "at_ms"])


def silence_stream(heartbeats: DataFrame, seconds: float = 15.0, source: Sequence[str] = ("source",)) -> DataFrame:
    """``event`` (``silent``, ``recovered``) per source, with the time of the last heartbeat and of the event.

    Time is the wall clock of the batches, so a source counts as silent although no row arrives at all; run it with a
    processing-time trigger shorter than ``seconds``.
    """
    use_disk_state(heartbeats.sparkSession)
    fields = [T.StructField(f"k{i}", heartbeats.schema[c].dataType) for i, c in enumerate(source)]
    schema = T.StructType([*fields, T.StructField("event", T.StringType()), T.StructField("seen_ms", T.LongType()), T.StructField("at_ms", T.LongType())])
    out = heartbeats.select(*source).groupBy(*source).transformWithStateInPandas(
        SilenceProcessor(seconds), schema, outputMode="Append", timeMode="ProcessingTime"
    )
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(source)), "event",
        F.timestamp_millis("seen_ms").alias("last_seen"), F.timestamp_millis("at_ms").alias("at"),
    )


class LateRows(StreamingQueryListener):
    """Counts, per query and batch, the rows that the watermark dropped.

    ``spark.streams.addListener(late)`` before the query starts; :meth:`table` is what has been seen, one row per batch
    and stateful operator that dropped anything.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for operator in p.stateOperators:
            if operator.numRowsDroppedByWatermark:
                self.rows.append((str(p.id), p.name or "", p.batchId, operator.operatorName, operator.numRowsDroppedByWatermark))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, name string, batch long, operator string, dropped long")
