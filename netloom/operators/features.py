"""78 statistics per flow in one grouped pass.

Statistics are kept per endpoint side and named forward/backward afterwards, so the
aggregation needs no direction.  Every buffer is a plain number, which keeps the plan
on hash aggregation; packets of a flow sit in one or two slices, so the map-side
combine leaves about one row per flow to shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import FlowParams
from netloom.operators.flows import KEY, close_reason, flow_key_columns
from netloom.schema import (
    ACK, CWE_BIT, ECE_BIT, FEATURE_NAMES, FIN, PSH, RST, SYN, URG,
)

ID_COLUMNS = (
    "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start", "last", "close_reason",
)


def _stats(prefix: str, x: str) -> dict[str, str]:
    return {
        f"{prefix}_n": f"count({x})",
        f"{prefix}_sum": f"sum({x})",
        f"{prefix}_min": f"min({x})",
        f"{prefix}_max": f"max({x})",
        f"{prefix}_var": f"var_samp({x})",
    }


def _partials() -> dict[str, str]:
    """Aggregates per flow, as SQL; per side where the feature has a direction."""
    length, header = "CAST(length AS BIGINT)", "CAST(header_len AS BIGINT)"
    aggs = {
        "last_us": "max(us)",
        "closed": "max(is_closing)",
        "followed": "count(*) = count(next_us)",
        **_stats("len", length),
        **_stats("iat", "us - prev_us"),
    }
    for name, bit in (
        ("fin", FIN), ("syn", SYN), ("rst", RST), ("psh", PSH),
        ("ack", ACK), ("urg", URG), ("cwe", CWE_BIT), ("ece", ECE_BIT),
    ):
        aggs[name] = f"count(CASE WHEN (tcp_flags & {bit}) != 0 THEN 1 END)"
    for side in (0, 1):
        mine = f"side = {side}"
        aggs.update(_stats(f"len{side}", f"CASE WHEN {mine} THEN {length} END"))
        aggs.update(_stats(f"iat{side}", f"CASE WHEN {mine} THEN us - prev_side_us END"))
        aggs[f"psh{side}"] = f"count(CASE WHEN {mine} AND (tcp_flags & {PSH}) != 0 THEN 1 END)"
        aggs[f"urg{side}"] = f"count(CASE WHEN {mine} AND (tcp_flags & {URG}) != 0 THEN 1 END)"
        aggs[f"hdr{side}_sum"] = f"sum(CASE WHEN {mine} THEN {header} END)"
        aggs[f"hdr{side}_min"] = f"min(CASE WHEN {mine} THEN {header} END)"
        aggs[f"data{side}"] = f"count(CASE WHEN {mine} AND length > header_len THEN 1 END)"
        # The first packet of a side is the one without a predecessor on that side.
        aggs[f"win{side}"] = f"max(CASE WHEN {mine} AND prev_side_us IS NULL THEN window_size END)"
    return aggs


def _features(real_active_idle: bool) -> dict[str, str]:
    """The 78 features as SQL over the aggregates."""

    def fwd(name: str) -> str:
        return f"if(first_side = 0, {name.format(0)}, {name.format(1)})"

    def bwd(name: str) -> str:
        return f"if(first_side = 0, {name.format(1)}, {name.format(0)})"

    def d(x: str) -> str:
        return f"coalesce(CAST({x} AS DOUBLE), 0D)"

    def mean(n: str, total: str) -> str:
        return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / {n} ELSE 0D END"

    def std(var: str) -> str:
        return f"coalesce(sqrt({var}), 0D)"

    seconds = "greatest((last_us - flow_start_us) / 1e6D, 1e-9D)"
    n_fwd, n_bwd = fwd("len{}_n"), bwd("len{}_n")
    v = {
        "Destination Port": d("dst_port"),
        "Flow Duration": d("last_us - flow_start_us"),
        "Total Fwd Packets": d(n_fwd),
        "Total Backward Packets": d(n_bwd),
        "Total Length of Fwd Packets": d(fwd("len{}_sum")),
        "Total Length of Bwd Packets": d(bwd("len{}_sum")),
        "Flow Bytes/s": f"len_sum / {seconds}",
        "Flow Packets/s": f"len_n / {seconds}",
        "Fwd Packets/s": f"{n_fwd} / {seconds}",
        "Bwd Packets/s": f"{n_bwd} / {seconds}",
        "Min Packet Length": d("len_min"),
        "Max Packet Length": d("len_max"),
        "Packet Length Mean": mean("len_n", "len_sum"),
        "Packet Length Std": std("len_var"),
        "Packet Length Variance": d("len_var"),
        "Down/Up Ratio": f"{n_bwd} / greatest({n_fwd}, 1)",
        "Flow IAT Mean": mean("iat_n", "iat_sum"),
        "Flow IAT Std": std("iat_var"),
        "Flow IAT Max": d("iat_max"),
        "Flow IAT Min": d("iat_min"),
        "Init_Win_bytes_forward": d(fwd("win{}")),
        "Init_Win_bytes_backward": d(bwd("win{}")),
        "act_data_pkt_fwd": d(fwd("data{}")),
        "min_seg_size_forward": d(fwd("hdr{}_min")),
    }
    for name, pick in (("Fwd", fwd), ("Bwd", bwd)):
        v[f"{name} Packet Length Max"] = d(pick("len{}_max"))
        v[f"{name} Packet Length Min"] = d(pick("len{}_min"))
        v[f"{name} Packet Length Mean"] = mean(pick("len{}_n"), pick("len{}_sum"))
        v[f"{name} Packet Length Std"] = std(pick("len{}_var"))
        v[f"{name} IAT Total"] = d(pick("iat{}_sum"))
        v[f"{name} IAT Mean"] = mean(pick("iat{}_n"), pick("iat{}_sum"))
        v[f"{name} IAT Std"] = std(pick("iat{}_var"))
        v[f"{name} IAT Max"] = d(pick("iat{}_max"))
        v[f"{name} IAT Min"] = d(pick("iat{}_min"))
        v[f"{name} PSH Flags"] = d(pick("psh{}"))
        v[f"{name} URG Flags"] = d(pick("urg{}"))
        v[f"{name} Header Length"] = d(pick("hdr{}_sum"))
    for flag in ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "CWE", "ECE"):
        v[f"{flag} Flag Count"] = d(flag.lower())
    # Features defined as another feature.
    for copy, of in (
        ("Average Packet Size", "Packet Length Mean"),
        ("Avg Fwd Segment Size", "Fwd Packet Length Mean"),
        ("Avg Bwd Segment Size", "Bwd Packet Length Mean"),
        ("Fwd Header Length.1", "Fwd Header Length"),
        ("Subflow Fwd Packets", "Total Fwd Packets"),
        ("Subflow Fwd Bytes", "Total Length of Fwd Packets"),
        ("Subflow Bwd Packets", "Total Backward Packets"),
        ("Subflow Bwd Bytes", "Total Length of Bwd Packets"),
    ):
        v[copy] = v[of]
    if real_active_idle:
        v.update({f"{k} {s}": d(f"`{k} {s}`") for k in ("Active", "Idle") for s in ("Mean", "Std", "Max", "Min")})
    return {name: v.get(name, "0D") for name in FEATURE_NAMES}


def flow_features(
    flow_packets: DataFrame,
    params: FlowParams = FlowParams(),
    now: str | None = None,
    real_active_idle: bool = False,
    activity_s: float = 5.0,
) -> DataFrame:
    """Key columns, start, last, close reason and the 78 features in model order.

    Bulk and active/idle features are constant 0.0, as the models were trained.
    ``real_active_idle`` computes the eight active/idle features instead: a gap above
    ``activity_s`` ends a stretch of activity and is one idle period.
    """
    aggs = [F.expr(sql).alias(name) for name, sql in _partials().items()]
    f = flow_packets.groupBy("flow_id", *KEY, "first_side", "flow_start_us").agg(*aggs)
    if real_active_idle:
        f = f.join(_active_idle(flow_packets, activity_s), "flow_id")
    f = f.withColumns({**flow_key_columns(), "close_reason": close_reason(params, now)})
    times = {"start": "timestamp_micros(flow_start_us)", "last": "timestamp_micros(last_us)"}
    return f.selectExpr(
        *(f"{times.get(n, n)} AS {n}" for n in ID_COLUMNS),
        *(f"{sql} AS `{name}`" for name, sql in _features(real_active_idle).items()),
    )


def _active_idle(flow_packets: DataFrame, activity_s: float) -> DataFrame:
    """Active and idle stretches of each flow, in microseconds.

    A flow lasts at most the absolute timeout, so its packets are a bounded window.
    """
    limit = round(activity_s * 1_000_000)
    w = Window.partitionBy("flow_id").orderBy("us", "packet_id")
    gap = F.col("us") - F.col("prev_us")
    stretches = (
        flow_packets.select("flow_id", "us", "packet_id", gap.alias("gap"))
        .withColumn("stretch", F.count(F.when(F.col("gap") > limit, 1)).over(w))
        .groupBy("flow_id", "stretch")
        .agg((F.max("us") - F.min("us")).alias("active"), F.max(F.when(F.col("gap") > limit, F.col("gap"))).alias("idle"))
    )
    aggs = []
    for kind in ("active", "idle"):
        x = F.col(kind).cast("double")
        for stat, fn in (("Mean", F.avg), ("Std", F.stddev_samp), ("Max", F.max), ("Min", F.min)):
            aggs.append(fn(x).alias(f"{kind.capitalize()} {stat}"))
    return stretches.groupBy("flow_id").agg(*aggs)
