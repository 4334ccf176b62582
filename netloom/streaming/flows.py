"""Flow assembly on a stream.

State per key is only the packets that are not emitted yet.  Packets wait in time buckets until the
watermark has passed them, so arrival order inside the watermark delay does not matter
and the result equals the batch operator on the same packets.  A packet that has been passed joins the open flow,
of which only the start and the last time are read; its packets are appended, and read once when the flow leaves the state
whole: on FIN/RST, when a later packet starts a new flow, or when the watermark passes
its idle or absolute deadline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.config import FlowParams
from netloom.operators.flows import KEY, assemble_flows, canonical_key, micros
from netloom.schema import FIN, RST
from netloom.session import use_disk_state
from netloom.streaming.buckets import TimeBuckets, read_state, waiting_rows

BUCKETS = 8  # time buckets to the shorter timeout
_PACKET = ("us", "packet_id", "side", "length", "header_len", "tcp_flags", "window_size")
_STATE = T.StructType(
    [T.StructField(n, T.LongType() if n in ("us", "packet_id") else T.IntegerType()) for n in _PACKET]
)
_KEY_FIELDS = [
    T.StructField("lo_ip", T.StringType()),
    T.StructField("lo_port", T.IntegerType()),
    T.StructField("hi_ip", T.StringType()),
    T.StructField("hi_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
]
_ADDED = [
    T.StructField(n, T.LongType()) for n in ("flow_id", "flow_start_us", "prev_us", "prev_side_us", "next_us")
] + [T.StructField("first_side", T.IntegerType()), T.StructField("is_closing", T.BooleanType())]

FLOW_PACKETS = T.StructType(_KEY_FIELDS + list(_STATE) + _ADDED)


def _closed_flow(key: tuple, flow: list[tuple], closed: bool) -> list[tuple]:
    """The packets of one finished flow with the columns the features need."""
    start_us, flow_id, first_side = flow[0][0], flow[0][1], flow[0][2]
    out, prev, prev_side = [], None, {}
    for i, p in enumerate(flow):
        us, side = p[0], p[2]
        follows = flow[i + 1][0] if i + 1 < len(flow) else us  # any value: the flow is over
        out.append((*key, *p, flow_id, start_us, prev, prev_side.get(side), follows, first_side,
                    closed and i + 1 == len(flow)))
        prev = prev_side[side] = us
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ``FLOW_PACKETS`` with the types that they have, which need not be found out."""
    kinds = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.BooleanType(): "boolean", T.StringType(): "string"}
    return pd.DataFrame({f.name: pd.array(column, kinds[f.dataType]) for f, column in zip(FLOW_PACKETS, map(list, zip(*rows, strict=True)), strict=True)})


class FlowProcessor(StatefulProcessor):
    def __init__(self, params: FlowParams, delay_us: int | None = None):
        self.delay_us = delay_us
        self.idle_us = round(params.idle_s * 1_000_000)
        self.absolute_us = round(params.absolute_s * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = TimeBuckets(handle, _STATE, min(self.idle_us, self.absolute_us) // BUCKETS, delay_us=self.delay_us)
        self.head = handle.getValueState("head", "start_us long, last_us long")
        self.packets = handle.getListState("packets", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.add(pdf[list(_PACKET)].itertuples(index=False, name=None))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = self._advance(key, timerValues.getCurrentWatermarkInMs())
        if done:
            yield _frame(done)

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, clock_ms: int) -> list[tuple]:
        """Replay what the watermark has passed; the open flow and later packets stay."""
        head = self.head.get()
        head = tuple(head) if head is not None else None
        held = stored = head is not None
        done, new = [], []
        ready = sorted(self.waiting.take(clock_ms))

        def leave(closed: bool) -> None:
            nonlocal head, stored, new
            flow = [*(tuple(p) for p in self.packets.get()), *new] if stored else new
            done.extend(_closed_flow(key, flow, closed))
            if stored:
                self.packets.clear()
            head, stored, new = None, False, []

        for p in ready:
            if head and (p[0] - head[1] > self.idle_us or p[0] - head[0] > self.absolute_us):
                leave(False)
            first = head is None
            head = (p[0] if first else head[0], p[0])
            new.append(p)
            if not first and p[5] & (FIN | RST):
                leave(True)
        if head and self.waiting.passed(clock_ms) > self._deadline(head):
            leave(False)
        if head is None:
            if held:
                self.head.clear()
        elif new:
            self.packets.appendList(new) if stored else self.packets.put(new)
            self.head.update(head)
            self.waiting.wake(self._deadline(head))
        return done

    def _deadline(self, head: tuple) -> int:
        return min(head[1] + self.idle_us, head[0] + self.absolute_us)


def assemble_stream(packets: DataFrame, params: FlowParams = FlowParams(), delay: str = "10 seconds") -> DataFrame:
    """Stream of the packets of finished flows, ready for ``flow_features`` per micro-batch.

    Packets later than ``delay`` behind the newest are dropped; Spark counts them in the
    query progress.  Use the RocksDB state store.
    """
    use_disk_state(packets.sparkSession)
    delay_us = packets.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{delay}')")).first()[0]
    keyed = canonical_key(packets).withColumn("us", micros()).withWatermark("ts", delay)
    return keyed.select("ts", *KEY, *_PACKET).groupBy(*KEY).transformWithStateInPandas(
        FlowProcessor(params, delay_us), FLOW_PACKETS, outputMode="Append", timeMode="EventTime"
    )


def open_packets(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Packets still in the state of a stopped query: those of open flows and those that wait."""
    rows = read_state(spark, checkpoint, "packets")
    value = [f.name for f in rows.schema if f.name not in ("key", "partition_id")][0]
    opened = rows.select("key.*", f"{value}.*")
    return opened.unionByName(waiting_rows(spark, checkpoint).select("key.*", *_PACKET))


def flush_open_flows(spark: SparkSession, checkpoint: str, params: FlowParams = FlowParams()) -> DataFrame:
    """End of stream: assemble what is still open, as the batch operator does."""
    rest = open_packets(spark, checkpoint)
    low = F.col("side") == 0
    as_sent = rest.select(
        "packet_id",
        F.timestamp_micros("us").alias("ts"),
        F.when(low, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("src_ip"),
        F.when(low, F.col("hi_ip")).otherwise(F.col("lo_ip")).alias("dst_ip"),
        F.when(low, F.col("lo_port")).otherwise(F.col("hi_port")).alias("src_port"),
        F.when(low, F.col("hi_port")).otherwise(F.col("lo_port")).alias("dst_port"),
        "protocol", "length", "header_len", "tcp_flags", "window_size",
    )
    return assemble_flows(as_sent, params)
