"""Packets to bidirectional flows.

Order is event time: ``(ts, packet_id)``.  A flow is named by the ``packet_id`` of its
first packet, which is unique, stable across reruns and needs no global counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import FlowParams
from netloom.operators.anchors import anchor_runs
from netloom.operators.stages import settle
from netloom.schema import FIN, RST

KEY = ("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol")


def micros(ts: str = "ts") -> Column:
    """Whole microseconds since the epoch, exact for gaps and ages."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def canonical_key(packets: DataFrame) -> DataFrame:
    """Add the endpoint pair in a fixed order, so both directions share one key.

    ``side`` is 0 when the sender is the lower endpoint, else 1; a packet from an
    endpoint to itself is always side 0.
    """
    src = F.struct(F.col("src_ip"), F.col("src_port"))
    dst = F.struct(F.col("dst_ip"), F.col("dst_port"))
    low = F.col("side") == 0

    def pick(lower: str, higher: str, default: str | int) -> Column:
        # Keys are never NULL, so that joins on them need no extra filter on the scan.
        return F.coalesce(F.when(low, F.col(lower)).otherwise(F.col(higher)), F.lit(default))

    return packets.withColumn("side", F.when(src <= dst, 0).otherwise(1)).withColumns(
        {
            "lo_ip": pick("src_ip", "dst_ip", ""),
            "lo_port": pick("src_port", "dst_port", 0),
            "hi_ip": pick("dst_ip", "src_ip", ""),
            "hi_port": pick("dst_port", "src_port", 0),
            "protocol": F.coalesce("protocol", F.lit(0)),
        }
    )


def filter_packets(packets: DataFrame, expr: str | Column = "protocol IN (1, 6, 17)") -> DataFrame:
    """Capture filter: any predicate on packet columns; the default keeps IP traffic."""
    return packets.where(expr)


def _seconds(value: float) -> int:
    return round(value * 1_000_000)


def sessionize_idle(packets: DataFrame, gap_s: float = 120.0, slice_s: float = 900.0) -> DataFrame:
    """Cut each key where the gap to the previous packet exceeds ``gap_s``.

    Adds the key columns, ``session_id`` (first packet) and ``session_start_us``.
    """
    df = canonical_key(packets).withColumn("us", micros())
    runs = anchor_runs(
        df, KEY, "us", "packet_id", gap_us=_seconds(gap_s) + 1, slice_us=_seconds(slice_s)
    )
    return runs.withColumnsRenamed({"anchor_id": "session_id", "anchor_us": "session_start_us"}).drop(
        "is_anchor", "session_us", "prev_us", "next_us"
    )


def assemble_flows(packets: DataFrame, params: FlowParams = FlowParams()) -> DataFrame:
    """Give every packet its flow: idle timeout, absolute timeout and FIN/RST close.

    Adds the key columns, ``us``, ``flow_id``, ``flow_start_us``, ``first_side``,
    ``direction``, ``is_closing`` and the neighbours the features need:
    ``prev_us`` (previous packet of the flow), ``prev_side_us`` (previous packet of the
    flow in the same direction) and ``next_us`` (next packet of the key, in or after the
    flow).
    """
    df = canonical_key(packets).withColumn("us", micros())
    runs = anchor_runs(
        df,
        KEY,
        "us",
        "packet_id",
        gap_us=_seconds(params.idle_s) + 1,
        limit_us=_seconds(params.absolute_s) + 1,
        slice_us=_seconds(params.slice_s),
        hot_rows=params.hot_rows,
        closes=F.col("tcp_flags").bitwiseAND(FIN | RST) != 0,
        tag="side",
        tracks={"lo": F.col("side") == 0, "hi": F.col("side") == 1},
    )
    prev = F.when(F.col("side") == 0, F.col("prev_lo")).otherwise(F.col("prev_hi"))
    in_flow = (F.col("_prev.us") > F.col("anchor_us")) | (
        (F.col("_prev.us") == F.col("anchor_us")) & (F.col("_prev.id") >= F.col("anchor_id"))
    )
    return (
        runs.withColumn("_prev", prev)
        .withColumns(
            {
                "prev_side_us": F.when(in_flow, F.col("_prev.us")),
                "prev_us": F.when(~F.col("is_anchor"), F.col("prev_us")),
                "direction": F.when(F.col("side") == F.col("anchor_tag"), "fwd").otherwise("bwd"),
            }
        )
        .withColumnsRenamed(
            {"anchor_id": "flow_id", "anchor_us": "flow_start_us", "anchor_tag": "first_side"}
        )
        .drop("_prev", "prev_lo", "prev_hi", "session_us", "is_anchor")
    )


def flow_key_columns() -> dict[str, Column]:
    """The 5-tuple as the first packet saw it."""
    fwd_lo = F.col("first_side") == 0
    return {
        "src_ip": F.when(fwd_lo, F.col("lo_ip")).otherwise(F.col("hi_ip")),
        "dst_ip": F.when(fwd_lo, F.col("hi_ip")).otherwise(F.col("lo_ip")),
        "src_port": F.when(fwd_lo, F.col("lo_port")).otherwise(F.col("hi_port")),
        "dst_port": F.when(fwd_lo, F.col("hi_port")).otherwise(F.col("lo_port")),
    }


def close_reason(params: FlowParams, now: str | None = None) -> Column:
    """Why a flow ended, from ``closed``, ``followed``, ``flow_start_us``, ``last_us``.

    A timed-out flow is named after the deadline that passed first.  A flow with no
    later packet is still open (``flush``) unless ``now`` (a timestamp literal: the
    clock at the end of the data) lies beyond a deadline.
    """
    idle_at = F.col("last_us") + F.lit(_seconds(params.idle_s))
    absolute_at = F.col("flow_start_us") + F.lit(_seconds(params.absolute_s))
    timed_out = F.col("followed")
    if now is not None:
        clock = F.unix_micros(F.lit(now).cast("timestamp"))
        timed_out = timed_out | (clock > F.least(idle_at, absolute_at))
    return (
        F.when(F.col("closed"), "FIN/RST")
        .when(~timed_out, "flush")
        .when(idle_at <= absolute_at, "idle_timeout")
        .otherwise("absolute_timeout")
    )


def flow_table(flow_packets: DataFrame, params: FlowParams = FlowParams(), now: str | None = None) -> DataFrame:
    """One row per flow: key, start, last, packets, bytes and close reason."""
    flows = flow_packets.groupBy("flow_id", *KEY, "first_side", "flow_start_us").agg(
        F.max("us").alias("last_us"),
        F.count("*").alias("packets"),
        F.sum(F.col("length").cast("long")).alias("bytes"),
        F.max("is_closing").alias("closed"),
        (F.count("*") == F.count("next_us")).alias("followed"),
    )
    return flows.withColumns(flow_key_columns()).select(
        "flow_id",
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "protocol",
        F.timestamp_micros("flow_start_us").alias("start"),
        F.timestamp_micros("last_us").alias("last"),
        "packets",
        "bytes",
        close_reason(params, now).alias("close_reason"),
    )


def active_flows(flows: DataFrame, params: FlowParams = FlowParams(), every: str = "10 seconds") -> DataFrame:
    """Open flows at the end of each time bucket.

    A flow is open from its first packet to its close: the closing packet, or the
    deadline that ends it.  The running sum goes over buckets, of which there are few,
    never over flows.
    """
    last, start = F.unix_micros("last"), F.unix_micros("start")
    deadline = F.least(last + F.lit(_seconds(params.idle_s)), start + F.lit(_seconds(params.absolute_s)))
    ends = (
        F.when(F.col("close_reason") == "FIN/RST", F.col("last"))
        .when(F.col("close_reason") != "flush", F.timestamp_micros(deadline))
    )
    edges = flows.select(
        F.explode(
            F.array(
                F.struct(F.col("start").alias("at"), F.lit(1).alias("step")),
                F.struct(ends.alias("at"), F.lit(-1).alias("step")),
            )
        ).alias("edge")
    ).where(F.col("edge.at").isNotNull())
    steps = edges.groupBy(F.window("edge.at", every).alias("bucket")).agg(F.sum("edge.step").alias("step"))
    steps = steps.select(
        F.col("bucket.start").alias("bucket_start"), F.to_date("bucket.start").alias("day"), "step"
    )
    # A few rows per day, used twice below; the flows behind them are assembled once.
    steps = settle(steps, "active")
    by_day = Window.partitionBy("day").orderBy("bucket_start")
    opening = steps.groupBy("day").agg(F.sum("step").alias("net"))
    opening = opening.select(
        "day",
        F.coalesce(
            F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("opening"),
    )
    return steps.join(opening, "day").select(
        "bucket_start",
        (F.col("opening") + F.sum("step").over(by_day)).alias("active_flows"),
    )
