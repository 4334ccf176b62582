"""Alert gates, dedup, statistics and feeds over scored flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.config import AlertParams
from netloom.functions.severity import severity_rank
from netloom.operators.anchors import HOT_ROWS, anchor_runs
from netloom.operators.stages import settle
from netloom.schema import SEVERITY_RANK

DEDUP_KEY = ("src_ip", "dst_ip", "attack_type")


def suppress_reason(params: AlertParams, columns: Sequence[str]) -> Column:
    """Why a scored flow raises no alert; NULL when it does.  The first failing gate wins."""
    least = SEVERITY_RANK.get(params.min_severity, 1)
    prob = F.col("meta_probability") if "meta_probability" in columns else F.col("attack_probability")
    if {"meta_probability", "attack_probability"} <= set(columns):
        prob = F.coalesce("meta_probability", "attack_probability")
    severity = F.coalesce("severity", F.lit("NONE"))
    kind = F.coalesce("attack_type", F.lit(""))
    # The wording of the reasons.
    return (
        F.when(~F.coalesce("is_attack", F.lit(False)), "BENIGN flow")
        .when(severity_rank(severity) < least, F.concat(F.lit("severity "), severity, F.lit(f" < min {params.min_severity}")))
        .when(
            prob < params.min_confidence,
            F.concat(F.lit("meta_probability "), F.format_string("%.3f", prob), F.lit(f" < min {params.min_confidence:.3f}")),
        )
        .when(kind.isin(*params.suppressed_types), F.concat(F.lit("attack_type '"), kind, F.lit("' suppressed")))
        .when(
            F.col("dst_port").isin(*params.suppressed_ports),
            F.concat(F.lit("dst_port "), F.col("dst_port").cast("string"), F.lit(" suppressed")),
        )
    )


def alert_rules(df: DataFrame, params: AlertParams = AlertParams()) -> DataFrame:
    """Add ``suppress_reason``."""
    return df.withColumn("suppress_reason", suppress_reason(params, df.columns))


def dedup_alerts(
    df: DataFrame,
    window_s: float = 60.0,
    *,
    key: Sequence[str] = DEDUP_KEY,
    ts: str = "ts",
    rid: str = "flow_id",
    slice_s: float | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Anchored, non-overlapping dedup windows per key.

    The first alert opens a window; a later one is a repeat while it is less than
    ``window_s`` after the window's first alert, and opens a new window otherwise.  Adds
    ``is_first``, ``anchor_ts`` and ``anchor_id``.  ``rid`` must be a unique BIGINT.
    """
    window_us = round(max(1.0, window_s) * 1_000_000)
    slice_us = round((slice_s or max(1.0, window_s) * 60) * 1_000_000)
    # A missing key part is a value of its own, as it is in a lookup table.
    names = [f"_key{i}" for i in range(len(key))]
    rows = df.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, key)})
    rows = rows.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    runs = anchor_runs(rows, names, "_us", rid, gap_us=window_us, limit_us=window_us, slice_us=slice_us, hot_rows=hot_rows)
    return runs.select(
        *(F.col(f"`{c}`") for c in df.columns),
        F.col("is_anchor").alias("is_first"),
        F.timestamp_micros("anchor_us").alias("anchor_ts"),
        "anchor_id",
    )


def suppression_summary(deduped: DataFrame, key: Sequence[str] = DEDUP_KEY, ts: str = "ts") -> DataFrame:
    """Per window: first and last alert and how many there were."""
    return (
        deduped.groupBy(*key, "anchor_id")
        .agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("count"))
        .drop("anchor_id")
    )


def decide(df: DataFrame, params: AlertParams = AlertParams(), *, ts: str = "ts", rid: str = "flow_id",
           slice_s: float | None = None) -> DataFrame:
    """Give every scored flow an ``outcome``: benign, suppressed, deduped or alert.

    The gated flows feed several branches of the dedup plan, so they are written once.
    """
    ruled = settle(alert_rules(df, params), "gated")
    passed = dedup_alerts(
        ruled.where(F.col("suppress_reason").isNull()), params.dedup_window_s, ts=ts, rid=rid, slice_s=slice_s
    )
    passed = passed.withColumn("outcome", F.when(F.col("is_first"), "alert").otherwise("deduped"))
    stopped = ruled.where(F.col("suppress_reason").isNotNull()).withColumn(
        "outcome", F.when(F.coalesce("is_attack", F.lit(False)), "suppressed").otherwise("benign")
    )
    return passed.drop("is_first", "anchor_ts", "anchor_id").unionByName(stopped)


def alert_stats(decisions: DataFrame) -> DataFrame:
    """One row of counters over the decision table.

    ``total_suppressed`` counts benign flows too: every flow stopped by a gate.
    """
    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    alert = F.col("outcome") == "alert"
    stats = decisions.agg(
        F.count("*").alias("total_flows"),
        n(alert).alias("total_alerts"),
        n(F.col("outcome").isin("benign", "suppressed")).alias("total_suppressed"),
        n(F.col("outcome") == "deduped").alias("total_deduped"),
        *(n(alert & (F.col("severity") == s)).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    )
    return stats.withColumn("alert_rate", F.round(alert_rate(F.col("total_alerts"), F.col("total_flows")), 4))


def alert_rate(alerts: Column, flows: Column) -> Column:
    """Share with the denominator floored at 1; also the attack rate of predictions."""
    return alerts / F.greatest(flows, F.lit(1))


def alerts_by(alerts: DataFrame, col: str) -> DataFrame:
    """Alerts per attack type or per severity."""
    return alerts.groupBy(col).agg(F.count("*").alias("alerts"))


def total_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("alerts"))


def recent_alerts(alerts: DataFrame, limit: int = 50, ts: str = "timestamp", rid: str = "id") -> DataFrame:
    """Newest first; at most 1000 rows."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return alerts.orderBy(F.desc(ts), F.desc(rid)).limit(limit)


def top_attack_types(df: DataFrame, n: int = 10) -> DataFrame:
    counts = df.groupBy("attack_type").agg(F.count("*").alias("flows"))
    return counts.orderBy(F.desc("flows"), "attack_type").limit(n)


def notification_queue(alerts: DataFrame, min_severity: str = "HIGH") -> DataFrame:
    """Alerts at or above a severity, each with the text to send."""
    # Fixed value: the wording of the message.
    message = F.format_string(
        "IDS ALERT\n\nAttack Type: %s\nSource IP: %s\nDestination IP: %s\nConfidence: %s%%\nSeverity: %s",
        "attack_type",
        "src_ip",
        "dst_ip",
        F.bround(F.col("attack_confidence") * 100, 0).cast("int").cast("string"),
        "severity",
    )
    wanted = SEVERITY_RANK.get(min_severity.upper(), 3)
    return alerts.where(severity_rank(F.upper("severity")) >= wanted).withColumn("message", message)


def attack_feed(predictions: DataFrame) -> DataFrame:
    """Attacks as one JSON object per row."""
    return predictions.where("is_attack").select(F.to_json(F.struct("*")).alias("value"))


def attack_type_changes(predictions: DataFrame, ts: str = "ts", rid: str = "flow_id", slice_s: float = 3600.0) -> DataFrame:
    """Rows where the current attack type differs from that of the previous flow.

    The previous flow is found inside a time slice; only the first flow of each slice
    needs the last type of the slice before, so no task sorts the whole table.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = predictions.withColumns({"_us": us, "_slice": F.floor(us / round(slice_s * 1_000_000))})
    w = Window.partitionBy("_slice").orderBy("_us", rid)
    rows = rows.withColumns({"_prev": F.lag("attack_type").over(w), "_first": F.row_number().over(w) == 1})
    last = rows.groupBy("_slice").agg(F.max_by("attack_type", F.struct("_us", rid)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.orderBy("_slice"))).drop("_last")
    rows = rows.join(before, "_slice")
    previous = F.when(F.col("_first"), F.coalesce("_before", F.lit("BENIGN"))).otherwise(F.col("_prev"))
    rows = rows.withColumn("previous_type", previous)
    return rows.where(F.col("previous_type") != F.col("attack_type")).select(
        F.col(ts), F.col(rid), "previous_type", "attack_type"
    )
