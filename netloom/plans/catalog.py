"""Every query over the given tables, with its check in plain SQL where SQL can say it.

A query is a function of ``(spark, sf_dir)``; the SQL text runs in DuckDB on the same
tables.  Timestamps are compared as microseconds, derived fractions rounded to 6 places.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.config import AlertParams, DetectionParams, FlowParams, ScoreParams
from netloom.functions import severity as sev
from netloom.operators import alerts, clean, evaluation, metrics, quality, scoring, splits, traffic
from netloom.operators.features import flow_features
from netloom.operators.flows import (
    active_flows, assemble_flows, canonical_key, filter_packets, flow_table, sessionize_idle,
)
from netloom.operators.stages import settle
from netloom.plans import views
from netloom.plans.detection import detect
from netloom.schema import BASE_SEVERITY, FEATURE_NAMES
from netloom.sources.packets import decode_frames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The events have a mean gap of hours, so the timeouts are hours too.
FLOWS = FlowParams(idle_s=21_600, absolute_s=43_200, slice_s=172_800)
DEDUP_S = 86_400.0
GATES = AlertParams(min_severity="MEDIUM", min_confidence=0.55, suppressed_types=("Bot",), suppressed_ports=(53,))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def us(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


# -- flows ---------------------------------------------------------------------------------

KEY = "lo_ip, lo_port, hi_ip, hi_port, protocol"

PACKETS = f"packets AS ({views.PACKETS_SQL})"

KEYED = f"""{PACKETS},
sided AS (SELECT *, epoch_us(ts) AS us,
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN 0 ELSE 1 END AS side FROM packets),
keyed AS (SELECT *, CASE WHEN side = 0 THEN src_ip ELSE dst_ip END AS lo_ip,
  CASE WHEN side = 0 THEN src_port ELSE dst_port END AS lo_port,
  CASE WHEN side = 0 THEN dst_ip ELSE src_ip END AS hi_ip,
  CASE WHEN side = 0 THEN dst_port ELSE src_port END AS hi_port FROM sided)"""

FLOW_CTE = f"""{KEYED},
ordered AS (SELECT *, dense_rank() OVER (ORDER BY {KEY}) AS kid,
  row_number() OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS rn FROM keyed),
walk AS (
  SELECT kid, rn, packet_id, us, us AS start_us, packet_id AS flow_id, side AS first_side, false AS closing
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT kid, rn, packet_id, us, CASE WHEN fresh THEN us ELSE start_us END,
    CASE WHEN fresh THEN packet_id ELSE flow_id END, CASE WHEN fresh THEN side ELSE first_side END,
    fin AND NOT fresh
  FROM (SELECT o.kid, o.rn, o.packet_id, o.us, o.side, (o.tcp_flags & 5) <> 0 AS fin, w.start_us, w.flow_id, w.first_side,
      w.closing OR o.us - w.us > 21600000000 OR o.us - w.start_us > 43200000000 AS fresh
    FROM walk w JOIN ordered o ON o.kid = w.kid AND o.rn = w.rn + 1) s),
fp AS (SELECT o.*, w.flow_id, w.start_us, w.first_side, w.closing,
    lead(o.us) OVER (PARTITION BY o.kid ORDER BY o.rn) AS next_us,
    o.us - lag(o.us) OVER (PARTITION BY w.flow_id ORDER BY o.rn) AS gap,
    o.us - lag(o.us) OVER (PARTITION BY w.flow_id, o.side ORDER BY o.rn) AS side_gap,
    row_number() OVER (PARTITION BY w.flow_id, o.side ORDER BY o.rn) AS side_no,
    o.side = w.first_side AS fwd
  FROM ordered o JOIN walk w ON o.kid = w.kid AND o.rn = w.rn),
flows AS (SELECT flow_id, any_value(CASE WHEN first_side = 0 THEN lo_ip ELSE hi_ip END) AS src_ip,
    any_value(CASE WHEN first_side = 0 THEN hi_ip ELSE lo_ip END) AS dst_ip,
    any_value(CASE WHEN first_side = 0 THEN lo_port ELSE hi_port END) AS src_port,
    any_value(CASE WHEN first_side = 0 THEN hi_port ELSE lo_port END) AS dst_port,
    any_value(protocol) AS protocol, any_value(start_us) AS start_us, max(us) AS last_us,
    count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
    CASE WHEN bool_or(closing) THEN 'FIN/RST' WHEN count(next_us) < count(*) THEN 'flush'
      WHEN max(us) + 21600000000 <= any_value(start_us) + 43200000000 THEN 'idle_timeout'
      ELSE 'absolute_timeout' END AS close_reason
  FROM fp GROUP BY flow_id)"""


@query(f"WITH {KEYED} SELECT {KEY}, count(*) AS packets, count(CASE WHEN side = 0 THEN 1 END) AS from_lo FROM keyed GROUP BY {KEY}")
def flow_key(spark, sf):
    keyed = canonical_key(views.packets(spark, sf))
    return keyed.groupBy("lo_ip", "lo_port", "hi_ip", "hi_port", "protocol").agg(
        F.count("*").alias("packets"), F.count(F.when(F.col("side") == 0, 1)).alias("from_lo")
    )


@query(f"WITH {PACKETS} SELECT protocol, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM packets WHERE dst_port IN (80, 443) AND protocol = 6 GROUP BY protocol")
def packet_filter(spark, sf):
    kept = filter_packets(views.packets(spark, sf), "dst_port IN (80, 443) AND protocol = 6")
    return kept.groupBy("protocol").agg(F.count("*").alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"))


@query(f"""WITH {PACKETS} SELECT packet_id, epoch_us(ts) AS us, src_ip, dst_ip, src_port, dst_port, protocol,
 greatest(length, 14 + header_len) AS length, header_len, tcp_flags, window_size FROM packets""")
def frame_decode(spark, sf):
    # Written first, as captured frames would be: the decoder then works on a plain column.
    df = decode_frames(settle(views.frames(spark, sf), "frames"))
    return df.select("packet_id", us("ts").alias("us"), *[c for c in df.columns if c not in ("packet_id", "ts")])


@query(f"""WITH {PACKETS} SELECT epoch_us(ts) AS us, src_ip, dst_ip, src_port, dst_port, protocol,
 greatest(length, 14 + header_len) AS length, header_len, tcp_flags, window_size FROM packets""")
def raw_frames(spark, sf):
    """Packets written as capture files and read back by byte ranges."""
    from netloom.sources.captures import read_captures, write_captures

    folder = _folder(spark, "captures")
    write_captures(views.frames(spark, sf), folder)
    df = decode_frames(read_captures(spark, folder, 1 << 20))
    return df.select(us("ts").alias("us"), *[c for c in df.columns if c not in ("packet_id", "ts")])


@query(f"""WITH {KEYED}, cut AS (SELECT *, CASE WHEN us - lag(us) OVER w > 21600000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS c
 FROM keyed WINDOW w AS (PARTITION BY {KEY} ORDER BY us, packet_id)),
s AS (SELECT *, sum(c) OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS no FROM cut)
SELECT min_by(packet_id, rn) AS session_id, min(us) AS start_us, max(us) AS last_us, count(*) AS packets
FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY us, packet_id) AS rn FROM s) GROUP BY {KEY}, no""")
def idle_sessions(spark, sf):
    s = sessionize_idle(views.packets(spark, sf), FLOWS.idle_s, FLOWS.slice_s)
    return s.groupBy("session_id").agg(
        F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count("*").alias("packets")
    )


def _flow_rows(flows: DataFrame) -> DataFrame:
    return flows.select(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", us("start").alias("start_us"),
        us("last").alias("last_us"), "packets", "bytes", "close_reason",
    )


@query(f"WITH RECURSIVE {FLOW_CTE} SELECT * FROM flows")
def flow_assembly(spark, sf):
    return _flow_rows(flow_table(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS))


SLICED = replace(FLOWS, hot_rows=None)


@query(SQL["flow_assembly"])
def flow_assembly_sliced(spark, sf):
    """The same flows by time slices, the way of keys that are too large for a task."""
    return _flow_rows(flow_table(assemble_flows(views.packets(spark, sf), SLICED), SLICED))


# A third of the packets on one pair of endpoints.
_HOT = {"src_ip": ("'10.9.9.1'", "'10.9.9.2'"), "dst_ip": ("'10.9.9.2'", "'10.9.9.1'"), "src_port": ("1000", "80"),
        "dst_port": ("80", "1000"), "protocol": ("6", "6")}
HOT_SQL = "SELECT packet_id, ts, " + ", ".join(
    f"CASE WHEN packet_id % 6 = 0 THEN {a} WHEN packet_id % 6 = 3 THEN {b} ELSE {c} END AS {c}" for c, (a, b) in _HOT.items()
) + f", length, header_len, tcp_flags, window_size FROM ({views.PACKETS_SQL}) p"


@query(f"WITH RECURSIVE {FLOW_CTE.replace(views.PACKETS_SQL, HOT_SQL)} SELECT * FROM flows")
def hot_flow_assembly(spark, sf):
    """One key holds a third of the packets and is cut by time."""
    packets = spark.sql(HOT_SQL.replace("FROM events", "FROM {src}"), src=views.table(spark, sf, "events"))
    packets = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    return _flow_rows(flow_table(assemble_flows(packets, SLICED), SLICED))


@query(f"WITH RECURSIVE {FLOW_CTE} SELECT packet_id, flow_id, CASE WHEN fwd THEN 'fwd' ELSE 'bwd' END AS direction FROM fp")
def packet_direction(spark, sf):
    return assemble_flows(views.packets(spark, sf), FLOWS).select("packet_id", "flow_id", "direction")


@query(f"""WITH RECURSIVE {FLOW_CTE},
ends AS (SELECT start_us AS edge, 1 AS step FROM flows UNION ALL
 SELECT CASE WHEN close_reason = 'FIN/RST' THEN last_us ELSE least(last_us + 21600000000, start_us + 43200000000) END, -1
 FROM flows WHERE close_reason <> 'flush'),
b AS (SELECT edge // 21600000000 * 21600000000 AS bucket_us, sum(step) AS step FROM ends GROUP BY 1)
SELECT bucket_us, CAST(sum(step) OVER (ORDER BY bucket_us) AS BIGINT) AS active_flows FROM b""")
def open_flows(spark, sf):
    flows = flow_table(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS)
    return active_flows(flows, FLOWS, "6 hours").select(us("bucket_start").alias("bucket_us"), "active_flows")


def _feature_sql() -> str:
    def stats(prefix: str, x: str, total: bool) -> list[tuple[str, str]]:
        out = [
            (f"{prefix} Mean", f"coalesce(CAST(sum({x}) AS DOUBLE) / count({x}), 0)"),
            (f"{prefix} Std", f"coalesce(stddev_samp({x}), 0)"),
            (f"{prefix} Max", f"coalesce(max({x}), 0)"),
            (f"{prefix} Min", f"coalesce(min({x}), 0)"),
        ]
        return out + ([(f"{prefix} Total", f"coalesce(sum({x}), 0)")] if total else [])

    sec = "greatest((max(us) - any_value(start_us)) / CAST(1000000 AS DOUBLE), CAST(1e-9 AS DOUBLE))"
    f: dict[str, str] = {
        "Destination Port": "any_value(CASE WHEN first_side = 0 THEN hi_port ELSE lo_port END)",
        "Flow Duration": "max(us) - any_value(start_us)",
        "Flow Bytes/s": f"sum(length) / {sec}",
        "Flow Packets/s": f"count(*) / {sec}",
        "Min Packet Length": "min(length)",
        "Max Packet Length": "max(length)",
        "Packet Length Mean": "CAST(sum(length) AS DOUBLE) / count(*)",
        "Packet Length Std": "coalesce(stddev_samp(length), 0)",
        "Packet Length Variance": "coalesce(var_samp(length), 0)",
        "Average Packet Size": "CAST(sum(length) AS DOUBLE) / count(*)",
        "Down/Up Ratio": "count(CASE WHEN NOT fwd THEN 1 END) / CAST(greatest(count(CASE WHEN fwd THEN 1 END), 1) AS DOUBLE)",
        "Init_Win_bytes_forward": "coalesce(max(CASE WHEN fwd AND side_no = 1 THEN window_size END), 0)",
        "Init_Win_bytes_backward": "coalesce(max(CASE WHEN NOT fwd AND side_no = 1 THEN window_size END), 0)",
        "act_data_pkt_fwd": "count(CASE WHEN fwd AND length > header_len THEN 1 END)",
        "min_seg_size_forward": "coalesce(min(CASE WHEN fwd THEN header_len END), 0)",
        **dict(stats("Flow IAT", "gap", False)),
    }
    for i, flag in enumerate(("FIN", "SYN", "RST", "PSH", "ACK", "URG", "CWE", "ECE")):
        f[f"{flag} Flag Count"] = f"count(CASE WHEN (tcp_flags & {1 << i}) <> 0 THEN 1 END)"
    for d, word, is_dir in (("Fwd", "Fwd", "fwd"), ("Bwd", "Backward", "NOT fwd")):
        length = f"CASE WHEN {is_dir} THEN length END"
        f[f"Total {word} Packets"] = f[f"Subflow {d} Packets"] = f"count({length})"
        f[f"Total Length of {d} Packets"] = f[f"Subflow {d} Bytes"] = f"coalesce(sum({length}), 0)"
        f.update(stats(f"{d} Packet Length", length, False))
        f[f"Avg {d} Segment Size"] = f[f"{d} Packet Length Mean"]
        f.update(stats(f"{d} IAT", f"CASE WHEN {is_dir} THEN side_gap END", True))
        f[f"{d} PSH Flags"] = f"count(CASE WHEN {is_dir} AND (tcp_flags & 8) <> 0 THEN 1 END)"
        f[f"{d} URG Flags"] = f"count(CASE WHEN {is_dir} AND (tcp_flags & 32) <> 0 THEN 1 END)"
        f[f"{d} Header Length"] = f"coalesce(sum(CASE WHEN {is_dir} THEN header_len END), 0)"
        f[f"{d} Packets/s"] = f"count({length}) / {sec}"
    f["Fwd Header Length.1"] = f["Fwd Header Length"]
    cols = [f'{_significant(n, f"CAST({f.get(n, 0)} AS DOUBLE)")} AS "{n}"' for n in FEATURE_NAMES]
    return f"WITH RECURSIVE {FLOW_CTE} SELECT flow_id, {', '.join(cols)} FROM fp GROUP BY flow_id"


def _significant(name: str, sql: str) -> str:
    """Deviations are compared in steps far above floating-point noise."""
    if name.endswith("IAT Std"):
        return f"round({sql} / 1000000, 3)"
    if name.endswith(("Std", "Variance")):
        return f"round({sql}, 4)"
    return sql


@query(_feature_sql())
def flow_statistics(spark, sf):
    f = flow_features(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS)
    return f.select("flow_id", *(F.expr(_significant(n, f"`{n}`")).alias(n) for n in FEATURE_NAMES))


@query(SQL["flow_statistics"])
def flow_statistics_sliced(spark, sf):
    f = flow_features(assemble_flows(views.packets(spark, sf), SLICED), SLICED)
    return f.select("flow_id", *(F.expr(_significant(n, f"`{n}`")).alias(n) for n in FEATURE_NAMES))


# -- cleaning and quality ------------------------------------------------------------------

FILES = f"files AS ({views.FILES_SQL})"
CLEAN = f"""{FILES}, nn AS (SELECT source_file, raw_label, label, f_qty,
 CASE WHEN isnan(f_rate) OR isinf(f_rate) THEN NULL ELSE f_rate END AS f_rate, f_tax FROM files)"""
FEATURES = ["f_qty", "f_rate", "f_tax"]


def _files(spark, sf):
    return views.file_rows(spark, sf)


@query(f"WITH {CLEAN} SELECT label, count(*) AS n, count(f_rate) AS n_rate, count(f_tax) AS n_tax, max(f_rate) AS max_rate FROM nn GROUP BY label")
def missing_to_null(spark, sf):
    return clean.normalise_missing(_files(spark, sf)).groupBy("label").agg(
        F.count("*").alias("n"), F.count("f_rate").alias("n_rate"), F.count("f_tax").alias("n_tax"), F.max("f_rate").alias("max_rate")
    )


@query(f"""WITH {FILES} SELECT replace(trim(raw_label), '�', '-') AS label,
 CASE WHEN upper(trim(label)) = 'N' THEN 0 ELSE 1 END AS attack, count(*) AS n FROM files GROUP BY 1, 2""")
def label_cleaning(spark, sf):
    df = clean.binary_label(_files(spark, sf), "label", benign="N").drop("label").withColumnRenamed("raw_label", "label")
    return clean.clean_labels(df).groupBy("label", "attack").agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority AS label, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS label_enc, count(*) AS n
FROM orders GROUP BY o_orderpriority""")
def label_encoding(spark, sf):
    df = views.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "label")
    encoded, model = clean.encode_labels(df)
    decoded = clean.decode_labels(encoded.drop("label"), model.labels)
    return decoded.groupBy("label", "label_enc").agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT label, max(CAST(f_qty AS REAL)) AS f_qty, max(CAST(f_tax AS REAL)) AS f_tax FROM files GROUP BY label")
def downcast_columns(spark, sf):
    return clean.downcast(_files(spark, sf)).groupBy("label").agg(F.max("f_qty").alias("f_qty"), F.max("f_tax").alias("f_tax"))


@query(f"WITH {CLEAN} SELECT source_file, median(f_qty) AS f_qty, median(f_rate) AS f_rate, median(f_tax) AS f_tax FROM nn GROUP BY source_file")
def file_medians(spark, sf):
    return clean.fit_medians(clean.normalise_missing(_files(spark, sf)), FEATURES)


@query(f"""WITH {CLEAN}, m AS (SELECT source_file, median(f_qty) AS q, median(f_rate) AS r, median(f_tax) AS t FROM nn GROUP BY source_file)
SELECT nn.source_file, label, round(sum(coalesce(f_rate, r)), 3) AS rate, round(sum(coalesce(f_tax, t)), 6) AS tax, count(*) AS n
FROM nn JOIN m ON nn.source_file = m.source_file GROUP BY nn.source_file, label""")
def median_imputation(spark, sf):
    df = clean.normalise_missing(_files(spark, sf))
    full = clean.impute_median(df, clean.fit_medians(df, FEATURES), FEATURES)
    return full.groupBy("source_file", "label").agg(
        F.round(F.sum("f_rate"), 3).alias("rate"), F.round(F.sum("f_tax"), 6).alias("tax"), F.count("*").alias("n")
    )


@query(f"WITH {CLEAN} SELECT median(f_qty) AS f_qty, median(f_rate) AS f_rate, median(f_tax) AS f_tax FROM nn")
def overall_medians(spark, sf):
    return clean.global_medians(clean.normalise_missing(_files(spark, sf)), FEATURES)


@query("""WITH c AS (SELECT event_id // 1000 AS chunk, median(value) AS m, count(*) AS n FROM events GROUP BY 1)
SELECT round(sum(m * n) / sum(n), 6) AS value FROM c""")
def chunked_medians(spark, sf):
    ev = views.table(spark, sf, "events")
    return r6(clean.global_medians(ev, ["value"], row_no="event_id", chunk_rows=1000), "value")


@query(f"""WITH {CLEAN}, d AS (SELECT DISTINCT * FROM nn), g AS (SELECT DISTINCT raw_label, label, f_qty, f_rate, f_tax FROM nn)
SELECT 'file' AS scope, count(*) AS n FROM d UNION ALL SELECT 'global', count(*) FROM g""")
def exact_duplicates(spark, sf):
    df = clean.normalise_missing(_files(spark, sf))
    parts = [
        clean.drop_exact_duplicates(df, scope).agg(F.lit(scope).alias("scope"), F.count("*").alias("n"))
        for scope in ("file", "global")
    ]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {CLEAN}, m AS (SELECT source_file, median(f_rate) AS r, median(f_tax) AS t FROM nn GROUP BY source_file),
i AS (SELECT DISTINCT nn.source_file, raw_label, label, f_qty, coalesce(f_rate, r) AS f_rate, coalesce(f_tax, t) AS f_tax
 FROM nn JOIN m ON nn.source_file = m.source_file)
SELECT replace(trim(raw_label), '�', '-') AS label, source_file, count(*) AS n, round(sum(f_rate), 3) AS rate FROM i GROUP BY 1, 2""")
def cleaned_table(spark, sf):
    done = clean.clean_table(_files(spark, sf), label="raw_label")
    return done.groupBy(F.col("raw_label").alias("label"), "source_file").agg(
        F.count("*").alias("n"), F.round(F.sum("f_rate"), 3).alias("rate")
    )


@query(f"WITH {FILES} SELECT label, round(sum(CASE WHEN isnan(f_rate) OR isinf(f_rate) THEN 250.0 ELSE f_rate END), 3) AS rate, round(sum(coalesce(f_tax, 0)), 6) AS tax FROM files GROUP BY label")
def inference_imputation(spark, sf):
    done = clean.impute_at_inference(_files(spark, sf), {"f_rate": 250.0}, ["f_rate", "f_tax"])
    return done.groupBy("label").agg(F.round(F.sum("f_rate"), 3).alias("rate"), F.round(F.sum("f_tax"), 6).alias("tax"))


@query(f"""WITH {FILES}, s AS (SELECT avg(f_qty) AS m, stddev_pop(f_qty) AS d FROM files WHERE label = 'N')
SELECT label, round(sum((f_qty - m) / d), 4) AS z, round(max((f_qty - m) / d), 6) AS z_max FROM files, s GROUP BY label""")
def standardised(spark, sf):
    df = _files(spark, sf)
    fitted = clean.fit_standardiser(df.where("label = 'N'"), ["f_qty"])
    return clean.standardise(df, fitted).groupBy("label").agg(F.round(F.sum("f_qty"), 4).alias("z"), F.round(F.max("f_qty"), 6).alias("z_max"))


@query(f"""WITH {CLEAN}, c AS (SELECT quantile_cont(f_rate, 0.99) AS hi FROM nn)
SELECT label, round(sum(CASE WHEN f_rate IS NOT NULL THEN least(f_rate, hi) END), 3) AS rate, round(max(least(f_rate, hi)), 6) AS top, count(f_rate) AS n FROM nn, c GROUP BY label""")
def clipped(spark, sf):
    done = clean.clip_quantile(clean.normalise_missing(_files(spark, sf)), ["f_rate"], 0.99)
    return done.groupBy("label").agg(
        F.round(F.sum("f_rate"), 3).alias("rate"), F.round(F.max("f_rate"), 6).alias("top"), F.count("f_rate").alias("n")
    )


@query(f"""WITH RECURSIVE {FLOW_CTE} SELECT count(*) AS flows, CAST(78 AS INT) AS features FROM flows""")
def validated_features(spark, sf):
    f = flow_features(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS)
    checked = clean.validate_features(f.select(*(clean.q(c) for c in reversed(f.columns))))
    return checked.agg(F.count("*").alias("flows"), F.lit(len(checked.columns)).alias("features"))


PROFILE_TAIL = """
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns, CAST(sum(miss * n) AS BIGINT) AS missing_cells,
 round(100.0 * sum(miss * n) / (sum(n) * 6), 6) AS missing_pct, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
 round(100.0 * (sum(n) - count(*)) / sum(n), 6) AS duplicate_pct,
 CAST(sum(CASE WHEN label = 'N' THEN n ELSE 0 END) AS BIGINT) AS benign,
 round(100.0 * sum(CASE WHEN label = 'N' THEN n ELSE 0 END) / sum(n), 6) AS benign_pct,
 CAST(sum(CASE WHEN label = 'N' THEN 0 ELSE n END) AS BIGINT) AS attack,
 round(100.0 * sum(CASE WHEN label = 'N' THEN 0 ELSE n END) / sum(n), 6) AS attack_pct,
 round(sum(CASE WHEN label = 'N' THEN n ELSE 0 END) / CAST(sum(CASE WHEN label = 'N' THEN 0 ELSE n END) AS DOUBLE), 6) AS imbalance_ratio
FROM d"""
PERCENTS = ("missing_pct", "duplicate_pct", "benign_pct", "attack_pct", "imbalance_ratio")


@query(f"""WITH {CLEAN}, d AS (SELECT *, count(*) AS n,
 CAST(f_rate IS NULL AS INT) + CAST(f_tax IS NULL AS INT) AS miss FROM nn GROUP BY ALL){PROFILE_TAIL}""")
def table_profile(spark, sf):
    return r6(quality.profile(_files(spark, sf), benign="N"), *PERCENTS)


@query("""WITH d AS (SELECT event_id // 1000 AS chunk, user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM d""")
def chunked_profile(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("label"))
    return quality.profile(ev, row_no="event_id", chunk_rows=1000).select("rows", "duplicate_rows")


@query(f"""WITH {FILES} SELECT replace(trim(raw_label), '�', '-') AS label, count(*) AS rows,
 round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM files GROUP BY 1""")
def label_shares(spark, sf):
    return r6(quality.label_distribution(_files(spark, sf), "raw_label"), "pct")


@query(f"""WITH {CLEAN}, b AS (SELECT label, count(*) AS n FROM nn GROUP BY label),
a AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT * FROM nn) GROUP BY label)
SELECT label, b.n AS before, a.n AS after, b.n - a.n AS lost, round(100.0 * (b.n - a.n) / b.n, 6) AS lost_pct FROM b JOIN a USING (label)""")
def label_losses(spark, sf):
    df = clean.normalise_missing(_files(spark, sf))
    return r6(quality.label_loss_report(df, clean.drop_exact_duplicates(df)), "lost_pct")


@query(f"""WITH {CLEAN} SELECT source_file, count(*) AS rows,
 CAST(sum(CAST(f_rate IS NULL AS INT) + CAST(f_tax IS NULL AS INT)) AS BIGINT) AS missing_cells,
 round(100.0 * sum(CAST(f_rate IS NULL AS INT) + CAST(f_tax IS NULL AS INT)) / (count(*) * 5), 6) AS missing_pct FROM nn GROUP BY source_file""")
def missing_cells(spark, sf):
    return r6(quality.missing_report(_files(spark, sf)), "missing_pct")


GATE = quality.Expectations(min_rows=10_000, max_rows=100_000, labels=3, ratio=(0.3, 0.7), rare=("A", "Z"), benign="N")


@query(f"""WITH {FILES}, d AS (SELECT *, count(*) AS n FROM files GROUP BY ALL),
m AS (SELECT sum(n) AS rows, sum(n) - count(*) AS dup, sum(CASE WHEN isnan(f_rate) THEN n ELSE 0 END + CASE WHEN f_tax IS NULL THEN n ELSE 0 END) AS nan,
 sum(CASE WHEN isinf(f_rate) THEN n ELSE 0 END) AS inf, count(DISTINCT label) AS labels,
 sum(CASE WHEN label = 'N' THEN n ELSE 0 END) AS benign,
 CAST(sum(CASE WHEN label = 'A' THEN n ELSE 0 END) = 0 AS INT) + CAST(sum(CASE WHEN label = 'Z' THEN n ELSE 0 END) = 0 AS INT) AS lost FROM d),
v AS (SELECT *, 100.0 * dup / rows AS dp, benign / CAST(rows - benign AS DOUBLE) AS ratio FROM m)
SELECT 1 AS no, 'rows' AS "check", CAST(rows AS DOUBLE) AS value, CASE WHEN rows BETWEEN 10000 AND 100000 THEN 'PASS' ELSE 'WARN' END AS status FROM v
UNION ALL SELECT 2, 'nan', nan, CASE WHEN nan = 0 THEN 'PASS' ELSE 'FAIL' END FROM v
UNION ALL SELECT 3, 'inf', inf, CASE WHEN inf = 0 THEN 'PASS' ELSE 'FAIL' END FROM v
UNION ALL SELECT 4, 'duplicate_pct', round(dp, 6), CASE WHEN dp < 0.5 THEN 'PASS' WHEN dp < 2 THEN 'INFO' ELSE 'WARN' END FROM v
UNION ALL SELECT 5, 'labels', labels, CASE WHEN labels = 3 THEN 'PASS' ELSE 'WARN' END FROM v
UNION ALL SELECT 6, 'benign_rows', benign, 'INFO' FROM v
UNION ALL SELECT 7, 'imbalance_ratio', round(ratio, 6), CASE WHEN ratio BETWEEN 0.3 AND 0.7 THEN 'PASS' ELSE 'WARN' END FROM v
UNION ALL SELECT 8, 'rare_classes_lost', lost, CASE WHEN lost = 0 THEN 'PASS' ELSE 'WARN' END FROM v
UNION ALL SELECT 9, 'verdict', nan + inf, CASE WHEN nan = 0 AND inf = 0 THEN 'PASS' ELSE 'FAIL' END FROM v""")
def gate(spark, sf):
    return r6(quality.quality_gate(_files(spark, sf), GATE), "value")


@query("SELECT CAST(user_id AS VARCHAR) AS label, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) < 60")
def rare_labels(spark, sf):
    ev = views.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("label"))
    return quality.rare_classes(ev, 60)


def _summary_sql() -> str:
    one = """SELECT '{0}' AS feature, count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std,
 min({0}) AS min, max({0}) AS max, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50,
 round(quantile_cont({0}, 0.75), 6) AS p75 FROM nn"""
    return f"WITH {CLEAN} " + " UNION ALL ".join(one.format(c) for c in FEATURES)


@query(_summary_sql())
def feature_stats(spark, sf):
    s = quality.feature_summary(clean.normalise_missing(_files(spark, sf)), FEATURES)
    return r6(s, "mean", "std", "p25", "p50", "p75")


# -- scores, alerts, traffic ----------------------------------------------------------------

META = "1 / (1 + exp(-(-9.94 + 7.3 * rf + 7.39 * xgb + 3.28 * iso)))"
_BASE = " ".join(f"WHEN '{k}' THEN {sev.SEVERITY_RANK[v]}" for k, v in BASE_SEVERITY.items() if "–" not in k)


def _severity_sql(name: str, conf: str, iso: str) -> str:
    base = f"(CASE {name} {_BASE} ELSE 2 END)"
    lowered = f"CASE WHEN {conf} < 0.5 THEN greatest({base} - 2, 1) WHEN {conf} < 0.75 THEN greatest({base} - 1, 1) ELSE {base} END"
    rank = f"least(({lowered}) + CASE WHEN {iso} >= 0.8 THEN 1 ELSE 0 END, 4)"
    return f"CASE WHEN {name} = 'UNKNOWN_ATTACK' THEN 'CRITICAL' ELSE (CASE {rank} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'NONE' END) END"


def _scored_sql(fires: str = "p >= 0.5", where: str = "") -> str:
    return f"""scored_in AS ({views.SCORED_SQL}),
p0 AS (SELECT *, {META} AS p FROM scored_in {where}),
p1 AS (SELECT *, {fires} AS is_attack FROM p0),
scored AS (SELECT flow_id, ts, epoch_us(ts) AS us, src_ip, dst_ip, src_port, dst_port, protocol, latency_ms, is_attack,
 round(p, 6) AS meta_probability, round(rf, 6) AS rf_probability, round(xgb, 6) AS xgb_probability, round(iso, 6) AS iso_score,
 CASE WHEN NOT is_attack THEN 'BENIGN' WHEN iso >= 0.7 THEN 'UNKNOWN_ATTACK' ELSE class_name END AS attack_type,
 CASE WHEN NOT is_attack THEN CAST(1 AS DOUBLE) WHEN iso >= 0.7 THEN round(p, 6) ELSE round(class_confidence, 6) END AS attack_confidence,
 CASE WHEN NOT is_attack THEN 'NONE' WHEN iso >= 0.7 THEN 'CRITICAL' ELSE {_severity_sql("class_name", "class_confidence", "iso")} END AS severity
 FROM p1)"""


SCORED = _scored_sql()
RULED = f"""{SCORED}, ruled AS (SELECT *, CASE WHEN NOT is_attack THEN 'BENIGN flow'
 WHEN severity = 'LOW' THEN 'severity LOW < min MEDIUM'
 WHEN meta_probability < 0.55 THEN concat('meta_probability ', printf('%.3f', meta_probability), ' < min 0.550')
 WHEN attack_type = 'Bot' THEN 'attack_type ''Bot'' suppressed'
 WHEN dst_port = 53 THEN 'dst_port 53 suppressed' END AS suppress_reason FROM scored)"""
# Dedup as a walk: each alert either repeats the open window or opens the next one.
DEDUP = f"""{RULED},
seq AS (SELECT *, dense_rank() OVER (ORDER BY src_ip, dst_ip, attack_type) AS kid,
  row_number() OVER (PARTITION BY src_ip, dst_ip, attack_type ORDER BY us, flow_id) AS rn FROM ruled WHERE suppress_reason IS NULL),
dwalk AS (SELECT kid, rn, us AS anchor_us, flow_id AS anchor_id FROM seq WHERE rn = 1
  UNION ALL SELECT s.kid, s.rn, CASE WHEN s.us - w.anchor_us >= 86400000000 THEN s.us ELSE w.anchor_us END,
   CASE WHEN s.us - w.anchor_us >= 86400000000 THEN s.flow_id ELSE w.anchor_id END
  FROM dwalk w JOIN seq s ON s.kid = w.kid AND s.rn = w.rn + 1),
deduped AS (SELECT s.*, w.anchor_us, w.anchor_id, w.anchor_id = s.flow_id AS is_first FROM seq s JOIN dwalk w ON s.kid = w.kid AND s.rn = w.rn)"""
DECIDED = f"""{DEDUP}, decided AS (SELECT *, CASE WHEN is_first THEN 'alert' ELSE 'deduped' END AS outcome FROM deduped
 UNION ALL BY NAME SELECT *, CASE WHEN is_attack THEN 'suppressed' ELSE 'benign' END AS outcome FROM ruled WHERE suppress_reason IS NOT NULL)"""
RAISED = f"{DECIDED}, raised AS (SELECT * FROM decided WHERE outcome = 'alert')"


def _scored(spark, sf):
    return scoring.score_stacking(views.scored_inputs(spark, sf))


def _passed(spark, sf):
    ruled = alerts.alert_rules(_scored(spark, sf), GATES)
    return alerts.dedup_alerts(ruled.where(F.col("suppress_reason").isNull()), DEDUP_S, slice_s=7 * DEDUP_S)


def _decisions(spark, sf):
    params = AlertParams(**{**GATES.__dict__, "dedup_window_s": DEDUP_S})
    return alerts.decide(_scored(spark, sf), params, slice_s=7 * DEDUP_S)


def _alerts(spark, sf):
    return _decisions(spark, sf).where("outcome = 'alert'")


SCORE_COLUMNS = ("flow_id", "is_attack", "meta_probability", "rf_probability", "xgb_probability", "iso_score",
                 "attack_type", "attack_confidence", "severity")


@query(f"WITH {SCORED} SELECT {', '.join(SCORE_COLUMNS)} FROM scored")
def stacking_scores(spark, sf):
    return _scored(spark, sf).select(*SCORE_COLUMNS)


@query(f"WITH {_scored_sql('xgb >= 0.8624')} SELECT attack_type, severity, count(*) AS n FROM scored GROUP BY ALL")
def single_model_scores(spark, sf):
    params = ScoreParams(binary_threshold=0.8624)
    s = scoring.score_stacking(views.scored_inputs(spark, sf), params, decision="single")
    return s.groupBy("attack_type", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {_scored_sql(where="WHERE flow_id % 10 <> 3 AND flow_id % 10 <> 4")} SELECT flow_id, is_attack, attack_type, CAST(NULL AS VARCHAR) AS error FROM scored
UNION ALL SELECT event_id, false, 'BENIGN', CASE event_id % 10 WHEN 3 THEN '1 missing feature(s): rf' ELSE '2 missing feature(s): xgb, iso' END
FROM events WHERE event_id % 10 IN (3, 4)""")
def batch_prediction(spark, sf):
    """Untrusted text input: bad rows carry an error, the others are scored."""
    bad = F.col("flow_id") % 10
    rows = views.scored_inputs(spark, sf).withColumns(
        {
            "rf": F.when(bad == 3, "n/a").otherwise(F.col("rf").cast("string")),
            "xgb": F.when(bad == 4, "").otherwise(F.col("xgb").cast("string")),
            "iso": F.when(bad != 4, F.col("iso").cast("string")),
        }
    )
    s = scoring.score_stacking(scoring.text_to_double(rows, ["rf", "xgb", "iso"]))
    return s.select("flow_id", "is_attack", "attack_type", "error")


@query(f"WITH s AS ({views.SCORED_SQL}) SELECT {_severity_sql('class_name', 'class_confidence', 'iso')} AS severity, class_name, count(*) AS n FROM s GROUP BY ALL")
def type_severity(spark, sf):
    s = sev.severity_by_type(F.col("class_name"), F.col("class_confidence"), F.col("iso"))
    return views.scored_inputs(spark, sf).groupBy(s.alias("severity"), "class_name").agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({views.SCORED_SQL}), w AS (SELECT greatest(0.0, least(1.0, xgb * 1.2)) * CAST(0.8 AS DOUBLE) + iso * CAST(0.2 AS DOUBLE) AS c FROM s),
t AS (SELECT CASE WHEN c >= 0.95 THEN 'CRITICAL' WHEN c >= 0.85 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM w)
SELECT severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS rank, count(*) AS n FROM t GROUP BY ALL""")
def weighted_severity(spark, sf):
    s = sev.severity_weighted(F.col("xgb") * 1.2, F.col("iso"))
    rows = views.scored_inputs(spark, sf).withColumn("severity", s)
    return rows.groupBy("severity", sev.severity_rank(F.col("severity")).alias("rank")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({views.SCORED_SQL}), r AS (SELECT min(-(0.5 - rf)) AS lo, max(-(0.5 - rf)) AS hi FROM s)
SELECT flow_id, round(greatest(0, least(1, (-(0.5 - rf) - lo) / (hi - lo + 1e-10))), 6) AS iso FROM s, r""")
def anomaly_scores(spark, sf):
    rows = views.scored_inputs(spark, sf).withColumn("iso_decision", F.lit(0.5) - F.col("rf"))
    lo, hi = scoring.fit_anomaly_range(rows)
    iso = scoring.normalise_anomaly(F.col("iso_decision"), ScoreParams(iso_min=lo, iso_max=hi))
    return rows.select("flow_id", F.round(iso, 6).alias("iso"))


@query(f"WITH {RULED} SELECT flow_id, suppress_reason FROM ruled")
def gated_alerts(spark, sf):
    return alerts.alert_rules(_scored(spark, sf), GATES).select("flow_id", "suppress_reason")


@query(f"WITH RECURSIVE {DEDUP} SELECT flow_id, is_first, anchor_us, anchor_id FROM deduped")
def deduped_alerts(spark, sf):
    return _passed(spark, sf).select("flow_id", "is_first", us("anchor_ts").alias("anchor_us"), "anchor_id")


@query(SQL["deduped_alerts"])
def deduped_alerts_sliced(spark, sf):
    ruled = alerts.alert_rules(_scored(spark, sf), GATES).where(F.col("suppress_reason").isNull())
    found = alerts.dedup_alerts(ruled, DEDUP_S, slice_s=7 * DEDUP_S, hot_rows=None)
    return found.select("flow_id", "is_first", us("anchor_ts").alias("anchor_us"), "anchor_id")


@query(f"""WITH RECURSIVE {DEDUP} SELECT src_ip, dst_ip, attack_type, min(us) AS first_us, max(us) AS last_us, count(*) AS count
FROM deduped GROUP BY src_ip, dst_ip, attack_type, anchor_id""")
def dedup_windows(spark, sf):
    s = alerts.suppression_summary(_passed(spark, sf))
    return s.select("src_ip", "dst_ip", "attack_type", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "count")


@query(f"""WITH RECURSIVE {DECIDED} SELECT count(*) AS total_flows, count(CASE WHEN outcome = 'alert' THEN 1 END) AS total_alerts,
 count(CASE WHEN outcome IN ('benign', 'suppressed') THEN 1 END) AS total_suppressed, count(CASE WHEN outcome = 'deduped' THEN 1 END) AS total_deduped,
 count(CASE WHEN outcome = 'alert' AND severity = 'CRITICAL' THEN 1 END) AS critical, count(CASE WHEN outcome = 'alert' AND severity = 'HIGH' THEN 1 END) AS high,
 count(CASE WHEN outcome = 'alert' AND severity = 'MEDIUM' THEN 1 END) AS medium, count(CASE WHEN outcome = 'alert' AND severity = 'LOW' THEN 1 END) AS low,
 round(count(CASE WHEN outcome = 'alert' THEN 1 END) / CAST(greatest(count(*), 1) AS DOUBLE), 4) AS alert_rate FROM decided""")
def alert_statistics(spark, sf):
    return alerts.alert_stats(_decisions(spark, sf))


@query(f"WITH RECURSIVE {RAISED} SELECT attack_type, count(*) AS alerts FROM raised GROUP BY 1")
def alerts_by_type(spark, sf):
    return alerts.alerts_by(_alerts(spark, sf), "attack_type")


@query(f"WITH RECURSIVE {RAISED} SELECT severity, count(*) AS alerts FROM raised GROUP BY 1")
def alerts_by_severity(spark, sf):
    return alerts.alerts_by(_alerts(spark, sf), "severity")


@query(f"WITH RECURSIVE {RAISED} SELECT count(*) AS alerts FROM raised")
def alert_total(spark, sf):
    return alerts.total_alerts(_alerts(spark, sf))


@query(f"WITH RECURSIVE {RAISED} SELECT flow_id, us, attack_type, severity FROM raised ORDER BY us DESC, flow_id DESC LIMIT 50")
def newest_alerts(spark, sf):
    rows = alerts.recent_alerts(_alerts(spark, sf), 50, ts="ts", rid="flow_id")
    return rows.select("flow_id", us("ts").alias("us"), "attack_type", "severity")


@query(f"""WITH RECURSIVE {RAISED} SELECT flow_id, concat('IDS ALERT', chr(10), chr(10), 'Attack Type: ', attack_type, chr(10), 'Source IP: ', src_ip, chr(10),
 'Destination IP: ', dst_ip, chr(10), 'Confidence: ', CAST(CAST(round_even(attack_confidence * 100, 0) AS INT) AS VARCHAR), '%', chr(10), 'Severity: ', severity) AS message
FROM raised WHERE severity IN ('HIGH', 'CRITICAL')""")
def notifications(spark, sf):
    return alerts.notification_queue(_alerts(spark, sf)).select("flow_id", "message")


@query(f"WITH {SCORED} SELECT attack_type, count(*) AS flows FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_attacks(spark, sf):
    return alerts.top_attack_types(_scored(spark, sf))


@query(f"""WITH {SCORED} SELECT concat('{{"flow_id":', flow_id, ',"attack_type":"', attack_type, '","severity":"', severity, '","is_attack":true}}') AS value
FROM scored WHERE is_attack""")
def attack_json(spark, sf):
    return alerts.attack_feed(_scored(spark, sf).select("flow_id", "attack_type", "severity", "is_attack"))


@query(f"""WITH {SCORED}, l AS (SELECT us, flow_id, coalesce(lag(attack_type) OVER (ORDER BY us, flow_id), 'BENIGN') AS previous_type, attack_type FROM scored)
SELECT * FROM l WHERE previous_type <> attack_type""")
def type_changes(spark, sf):
    c = alerts.attack_type_changes(_scored(spark, sf), slice_s=DEDUP_S)
    return c.select(us("ts").alias("us"), "flow_id", "previous_type", "attack_type")


COUNTERS = """count(*) AS flows, count(*) AS predictions, count(CASE WHEN is_attack THEN 1 END) AS attacks,
 count(CASE WHEN NOT is_attack THEN 1 END) AS benign, count(CASE WHEN attack_type = 'UNKNOWN_ATTACK' THEN 1 END) AS unknown_attacks,
 count(CASE WHEN is_attack AND attack_confidence >= 0.85 THEN 1 END) AS high_confidence_attacks,
 count(CASE WHEN iso_score > 0 THEN 1 END) AS anomalies, CAST(0 AS BIGINT) AS errors,
 round(count(CASE WHEN is_attack THEN 1 END) / CAST(count(*) AS DOUBLE), 6) AS attack_rate"""


@query(f"WITH {SCORED} SELECT {COUNTERS} FROM scored")
def counters(spark, sf):
    return r6(traffic.traffic_counters(_scored(spark, sf)), "attack_rate")


@query(f"WITH {SCORED} SELECT us // 86400000000 * 86400000000 AS window_us, {COUNTERS} FROM scored GROUP BY 1")
def daily_counters(spark, sf):
    c = traffic.traffic_counters(_scored(spark, sf), "1 day").drop("window_end")
    return r6(c.withColumn("window_us", us("window_start")).drop("window_start"), "attack_rate")


@query(f"WITH {SCORED} SELECT attack_type, count(*) AS predictions, count(CASE WHEN is_attack THEN 1 END) AS attacks FROM scored GROUP BY 1")
def type_counters(spark, sf):
    return traffic.attacks_by_type(_scored(spark, sf))


@query(f"WITH RECURSIVE {FLOW_CTE} SELECT src_ip, count(*) AS flows FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_sources(spark, sf):
    return traffic.top_talkers(flow_table(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS), "src_ip")


@query(f"WITH RECURSIVE {FLOW_CTE} SELECT dst_ip, count(*) AS flows FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_destinations(spark, sf):
    return traffic.top_talkers(flow_table(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS), "dst_ip")


@query(f"WITH {PACKETS} SELECT src_ip, count(*) AS flows FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def frequent_sources(spark, sf):
    """The most frequent senders of all packets, by a summary and an exact count of its candidates."""
    return traffic.frequent_talkers(views.packets(spark, sf), "src_ip", tracked=4096)


@query(f"WITH {SCORED} SELECT CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(protocol AS VARCHAR) END AS protocol, count(*) AS flows FROM scored GROUP BY 1")
def protocol_shares(spark, sf):
    return traffic.protocol_flows(_scored(spark, sf))


@query(f"WITH {SCORED} SELECT attack_confidence, rf_probability, xgb_probability, iso_score, meta_probability, attack_type FROM scored ORDER BY us DESC, flow_id DESC LIMIT 1")
def current_gauges(spark, sf):
    return traffic.latest_gauges(_scored(spark, sf))


# The rule scores of flows in SQL; default gates let every attack through.
DETECT_IN = f"""{FLOW_CTE},
feats AS (SELECT flow_id, least(log10(1 + count(*) / greatest((max(us) - any_value(start_us)) / CAST(1000000 AS DOUBLE), CAST(1e-9 AS DOUBLE))) / 11, 1) AS rf,
  least(CAST(sum(length) AS DOUBLE) / count(*) / 400, 1) AS xgb, least(coalesce(stddev_samp(length), 0) / 300, 1) AS iso,
  CASE WHEN count(CASE WHEN (tcp_flags & 2) <> 0 THEN 1 END) > 0 THEN 'PortScan'
   WHEN count(CASE WHEN (tcp_flags & 1) <> 0 THEN 1 END) > 0 THEN 'DDoS' ELSE 'Bot' END AS class_name
  FROM fp GROUP BY flow_id),
scored_in AS (SELECT f.*, greatest(rf, xgb) AS class_confidence, make_timestamp(last_us) AS ts, CAST(0 AS DOUBLE) AS latency_ms,
  src_ip, dst_ip, src_port, dst_port, protocol FROM feats f JOIN flows USING (flow_id))"""
_GATED = f"{SCORED}, ruled AS (SELECT *, CASE WHEN NOT is_attack THEN 'BENIGN flow' END AS suppress_reason FROM scored)"
DETECTED = DECIDED.replace(RULED, _GATED).replace(f"scored_in AS ({views.SCORED_SQL})", DETECT_IN)


@query(f"WITH RECURSIVE {DETECTED} SELECT outcome, attack_type, severity, count(*) AS flows FROM decided GROUP BY ALL")
def detection(spark, sf):
    """The whole batch plan, packets to decisions."""
    params = DetectionParams(flows=FLOWS, alerts=AlertParams(dedup_window_s=DEDUP_S))
    d = detect(views.packets(spark, sf), views.rule_scores, params)
    return d.groupBy("outcome", "attack_type", "severity").agg(F.count("*").alias("flows"))


# -- evaluation ------------------------------------------------------------------------------

EVAL = f"ev AS (SELECT CASE WHEN label = 'R' THEN 1 ELSE 0 END AS y, {META} AS p, rf, xgb, iso, label FROM ({views.FL_SQL}) f)"


def _curve_sql(score: str) -> str:
    return f"""{EVAL}, g AS (SELECT {score} AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM ev GROUP BY 1),
c AS (SELECT threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
 FROM g WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / np AS recall FROM c)"""


XGB, RF = _curve_sql("xgb"), _curve_sql("rf")


def _eval_rows(spark, sf):
    fl = views.labelled_rows(spark, sf)
    p = scoring.meta_probability(F.col("rf"), F.col("xgb"), F.col("iso"))
    return fl.withColumns({"y": F.when(F.col("label") == "R", 1).otherwise(0), "p": p})


@query(f"WITH {XGB} SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr")
def precision_recall(spark, sf):
    return r6(evaluation.pr_curve(_eval_rows(spark, sf), "xgb", "y"), "threshold", "precision", "recall")


@query(f"WITH {XGB} SELECT round(threshold, 6) AS threshold, round(fp / CAST(nn AS DOUBLE), 6) AS fpr, round(tp / CAST(np AS DOUBLE), 6) AS tpr FROM c")
def roc_points(spark, sf):
    return r6(evaluation.roc_curve(_eval_rows(spark, sf), "xgb", "y"), "threshold", "fpr", "tpr")


@query(f"""WITH {RF}, f AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10) AS f1 FROM pr)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""")
def best_threshold(spark, sf):
    best = evaluation.best_f1_threshold(evaluation.pr_curve(_eval_rows(spark, sf), "rf", "y"))
    return r6(best, "threshold", "f1", "precision", "recall")


@query(f"""WITH {EVAL}, t AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(i)),
g AS (SELECT threshold, coalesce(sum(y) FILTER (WHERE xgb >= threshold), 0) AS tp, coalesce(sum(1 - y) FILTER (WHERE xgb >= threshold), 0) AS fp, sum(y) AS np FROM ev, t GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CAST(tp AS DOUBLE) / np AS recall FROM g)
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(2 * (precision * recall) / (precision + recall + 1e-10), 6) AS f1 FROM q""")
def grid_thresholds(spark, sf):
    return r6(evaluation.threshold_grid(_eval_rows(spark, sf), "xgb", "y"), "threshold", "precision", "recall", "f1")


_AREAS = """round(sum(neg * (2.0 * tp - pos)) / (2.0 * sum(pos) * sum(neg)), 6) AS roc_auc,
 round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / sum(pos), 6) AS pr_auc"""


@query(f"WITH {_curve_sql('p')} SELECT {_AREAS} FROM c")
def curve_areas(spark, sf):
    return r6(evaluation.auc_scores(_eval_rows(spark, sf), "p", "y"), "roc_auc", "pr_auc")


_RATES = """round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision,
 round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1,
 round(coalesce(fp / CAST(nullif(fp + tn, 0) AS DOUBLE), 0), 6) AS fpr, round(coalesce(fn / CAST(nullif(fn + tp, 0) AS DOUBLE), 0), 6) AS fnr"""
RATES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr", "roc_auc", "pr_auc")


def _counts_sql(score: str, t: float) -> str:
    return f"""count(CASE WHEN y = 0 AND {score} < {t} THEN 1 END) AS tn, count(CASE WHEN y = 0 AND {score} >= {t} THEN 1 END) AS fp,
 count(CASE WHEN y = 1 AND {score} < {t} THEN 1 END) AS fn, count(CASE WHEN y = 1 AND {score} >= {t} THEN 1 END) AS tp"""


@query(f"""WITH {_curve_sql('p')}, b AS (SELECT {_counts_sql('p', 0.5)} FROM ev), a AS (SELECT {_AREAS} FROM c)
SELECT tn, fp, fn, tp, {_RATES}, roc_auc, pr_auc FROM b, a""")
def binary_quality(spark, sf):
    return r6(evaluation.binary_metrics(_eval_rows(spark, sf), "y", "p", 0.5), *RATES)


def _comparison_sql() -> str:
    parts = []
    for name, score, t in (("rf", "rf", 0.6), ("xgb", "xgb", 0.8624), ("iso", "iso", 0.369)):
        parts.append(
            f"""SELECT * FROM (WITH {_curve_sql(score)}, b AS (SELECT {_counts_sql(score, t)} FROM ev), a AS (SELECT {_AREAS} FROM c)
 SELECT '{name}' AS model, CAST({t} AS DOUBLE) AS threshold, tn, fp, fn, tp, {_RATES}, roc_auc, pr_auc FROM b, a)"""
        )
    return " UNION ALL ".join(parts)


@query(_comparison_sql())
def compared_models(spark, sf):
    models = {"rf": ("rf", 0.6), "xgb": ("xgb", 0.8624), "iso": ("iso", 0.369)}
    return r6(evaluation.model_comparison(_eval_rows(spark, sf), "y", models), *RATES)


PREDICTED = f"pd AS (SELECT label, CASE WHEN p >= 0.7 THEN 'R' WHEN xgb >= 0.5 THEN 'N' ELSE 'A' END AS pred FROM ({EVAL.removeprefix('ev AS (').removesuffix(')')}) e)"


def _predicted(spark, sf):
    pred = F.when(F.col("p") >= 0.7, "R").when(F.col("xgb") >= 0.5, "N").otherwise("A")
    return _eval_rows(spark, sf).withColumn("pred", pred)


@query(f"""WITH {PREDICTED}, k AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS c)
SELECT a.c AS y_true, b.c AS y_pred, count(pred) AS rows FROM k a JOIN k b ON true LEFT JOIN pd ON label = a.c AND pred = b.c GROUP BY 1, 2""")
def class_confusion(spark, sf):
    return evaluation.confusion_matrix(_predicted(spark, sf), "label", "pred", ["A", "N", "R", "Z"])


_REPORT = f"""{PREDICTED}, k AS (SELECT DISTINCT label AS class FROM pd UNION SELECT DISTINCT pred FROM pd),
s AS (SELECT class, count(CASE WHEN label = class THEN 1 END) AS support, count(CASE WHEN pred = class THEN 1 END) AS predicted,
 count(CASE WHEN label = class AND pred = class THEN 1 END) AS tp FROM k, pd GROUP BY 1),
rep AS (SELECT class, support, coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall,
 2 * tp / CAST(support + predicted AS DOUBLE) AS f1, support < 50 AS rare FROM s)"""


@query(f"WITH {_REPORT} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, rare FROM rep")
def class_report(spark, sf):
    return r6(evaluation.per_class_report(_predicted(spark, sf), "label", "pred"), "precision", "recall", "f1")


@query(f"""WITH {_REPORT} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy,
 round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM rep""")
def averaged_report(spark, sf):
    rep = evaluation.per_class_report(_predicted(spark, sf), "label", "pred")
    m = evaluation.macro_weighted(rep)
    return r6(m, *m.columns)


@query(f"WITH f AS ({views.FL_SQL}) SELECT count(*) AS test_records, count(CASE WHEN label <> 'N' THEN 1 END) AS attack_count, count(CASE WHEN label = 'N' THEN 1 END) AS benign_count FROM f")
def attack_counts(spark, sf):
    return evaluation.class_counts(views.labelled_rows(spark, sf), benign="N")


# -- splits ----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT label, CAST(round(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS a, CAST(round(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS b, n FROM c)
SELECT label, 'train' AS split, a AS n FROM x UNION ALL SELECT label, 'val', b - a FROM x UNION ALL SELECT label, 'test', n - b FROM x""")
def split_sizes(spark, sf):
    fl = views.labelled_rows(spark, sf)
    # 0.7 + 0.1 is a little below 0.8 in floating point; the limits are rounded row counts.
    parts = splits.stratified_split(fl, "label", {"train": 0.7, "val": 0.1, "test": 0.2})
    return parts.groupBy("label", "split").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS label, count(*) AS rows, round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 6) AS weight FROM lineitem GROUP BY 1")
def balanced_weights(spark, sf):
    return r6(splits.class_weights(views.labelled_rows(spark, sf)), "weight")


@query("""SELECT count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS negatives, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS positives,
 round(count(CASE WHEN l_returnflag = 'N' THEN 1 END) / CAST(count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS DOUBLE), 6) AS scale_pos_weight FROM lineitem""")
def attack_weight(spark, sf):
    return r6(splits.positive_weight(clean.binary_label(views.labelled_rows(spark, sf), benign="N")), "scale_pos_weight")


# -- latency, rates, rules ---------------------------------------------------------------------

BOUNDS = "0.1, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500"
HIST = f"""b AS (SELECT CAST(unnest([{BOUNDS}]) AS DOUBLE) AS le UNION ALL SELECT CAST('Infinity' AS DOUBLE)),
h AS (SELECT event_type, le, count(CASE WHEN value <= le THEN 1 END) AS cum_count, count(*) AS count, sum(value) AS sum FROM events, b GROUP BY 1, 2)"""


def _latencies(spark, sf):
    return views.table(spark, sf, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "latency_ms": F.col("value")})


@query(f"WITH {HIST} SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(CAST(le AS DECIMAL(9, 1)) AS VARCHAR) END AS le, cum_count, count, round(sum, 3) AS sum FROM h")
def latency_buckets(spark, sf):
    h = metrics.latency_histogram(_latencies(spark, sf), by=["event_type"])
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("decimal(9,1)").cast("string"))
    return h.withColumns({"le": le, "sum": F.round("sum", 3)})


@query(f"""WITH {HIST}, l AS (SELECT *, lag(le, 1, 0) OVER w AS lower, lag(cum_count, 1, 0) OVER w AS below, max(cum_count) OVER (PARTITION BY event_type) AS total
 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
r AS (SELECT *, CAST(0.95 AS DOUBLE) * total AS rank FROM l)
SELECT event_type, round(min_by(CASE WHEN isinf(le) THEN lower ELSE lower + (le - lower) * (rank - below) / (cum_count - below) END, le), 6) AS value
FROM r WHERE cum_count >= rank GROUP BY 1""")
def bucket_quantile(spark, sf):
    h = metrics.latency_histogram(_latencies(spark, sf), by=["event_type"])
    return r6(metrics.histogram_quantile(h, 0.95, ["event_type"]), "value")


LATENCY = """o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
summary AS (SELECT event_type, count(*) AS samples, avg(value) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
 max(CASE WHEN i = CAST(floor(CAST(0.5 AS DOUBLE) * n) AS BIGINT) THEN value END) AS p50_ms, max(CASE WHEN i = CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) THEN value END) AS p95_ms,
 max(CASE WHEN i = CAST(floor(CAST(0.99 AS DOUBLE) * n) AS BIGINT) THEN value END) AS p99_ms, 1000 / avg(value) AS throughput_per_s FROM o GROUP BY 1)"""


@query(f"WITH {LATENCY} SELECT event_type, samples, round(avg_ms, 6) AS avg_ms, min_ms, max_ms, p50_ms, p95_ms, p99_ms, round(throughput_per_s, 6) AS throughput_per_s FROM summary")
def latency_overview(spark, sf):
    return r6(metrics.latency_summary(_latencies(spark, sf), by=["event_type"]), "avg_ms", "throughput_per_s")


@query(f"""WITH {LATENCY}, w AS (SELECT sum(CASE event_type WHEN 'view' THEN avg_ms * 0.835 WHEN 'error' THEN avg_ms * 0.165 ELSE 0 END) AS a FROM summary)
SELECT round(a, 6) AS avg_ms, round(1000 / a, 6) AS throughput_per_s FROM w""")
def overall_latency(spark, sf):
    s = metrics.latency_summary(_latencies(spark, sf), by=["event_type"])
    return r6(metrics.weighted_latency(s, "event_type", {"view": 0.835, "error": 0.165}), "avg_ms", "throughput_per_s")


@query("SELECT event_type, count(*) AS samples, true AS p50_near, true AS p95_near, true AS p99_near FROM events GROUP BY 1")
def sketched_latency(spark, sf):
    """Hourly sketches merged per type; an estimate is near if the share of values up to it is within twice the sketch's error of its percent."""
    events = _latencies(spark, sf)
    merged = metrics.merged_latency(metrics.latency_sketches(events, by=["event_type"]), ["event_type"])
    joined = events.join(F.broadcast(merged.withColumnRenamed("event_type", "of")), F.col("event_type") == F.col("of"))
    off = 2 * metrics.rank_error()
    near = []
    for p in (50, 95, 99):
        below = F.avg((F.col("latency_ms") < F.col(f"p{p}_ms")).cast("int"))
        upto = F.avg((F.col("latency_ms") <= F.col(f"p{p}_ms")).cast("int"))
        near.append(((below <= p / 100 + off) & (upto >= p / 100 - off)).alias(f"p{p}_near"))
    return joined.groupBy("event_type").agg(F.first("samples").alias("samples"), *near)


@query("""WITH s AS (SELECT event_type AS name, ts, epoch_us(ts) AS us, event_id % 100 AS value FROM events),
l AS (SELECT *, lag(us) OVER w AS pu, lag(value) OVER w AS pv FROM s WINDOW w AS (PARTITION BY name ORDER BY us))
SELECT name, us, value, round(greatest((value - pv) / greatest((us - pu) / CAST(1000000 AS DOUBLE), 0.001), 0), 6) AS rate FROM l WHERE pu IS NOT NULL""")
def counter_rates(spark, sf):
    # A stored counter that resets after 99.
    events = views.table(spark, sf, "events")
    samples = events.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp"), (F.col("event_id") % 100).alias("value"))
    return r6(metrics.counter_rate(samples), "rate").select("name", us("ts").alias("us"), "value", "rate")


@query("SELECT epoch_us(ts) // 5000000 * 5000000 AS window_us, count(*) AS events, count(*) / CAST(5 AS DOUBLE) AS per_second FROM events GROUP BY 1")
def events_per_second(spark, sf):
    return metrics.per_second(_latencies(spark, sf)).select(us("window_start").alias("window_us"), "events", "per_second")


@query("""WITH s AS (SELECT epoch_us(ts) // 300000000 AS b FROM events WHERE event_type = 'error'),
w AS (SELECT b + i AS e FROM s, range(1, 13) r(i))
SELECT e * 300000000 AS us, count(*) AS increase FROM w GROUP BY 1""")
def hourly_increase(spark, sf):
    return metrics.increase(_latencies(spark, sf), "1 hour", "5 minutes", "event_type = 'error'").select(us("ts").alias("us"), "increase")


def _hold_sql(value: str, limit: str, step: int, hold: int) -> str:
    return f"""e AS (SELECT epoch_us(ts) // {step} * {step} AS us, {value} > {limit} AS c FROM events GROUP BY 1),
m AS (SELECT *, CASE WHEN c AND lag(c) OVER (ORDER BY us) AND us - lag(us) OVER (ORDER BY us) <= {step} THEN 0 ELSE 1 END AS cut FROM e),
i AS (SELECT *, sum(cut) OVER (ORDER BY us) AS run FROM m),
held AS (SELECT min(us) AS started_us, min(us) + {hold} AS fired_us, max(us) AS ended_us FROM i WHERE c GROUP BY run HAVING max(us) - min(us) >= {hold})"""


RATIO = _hold_sql("count(CASE WHEN event_type IN ('error', 'click') THEN 1 END) / CAST(count(*) AS DOUBLE)", "0.25", 3_600_000_000, 7_200_000_000)


def _micros(df: DataFrame) -> DataFrame:
    return df.select(us("started").alias("started_us"), us("fired").alias("fired_us"), us("ended").alias("ended_us"))


def _high_ratio(spark, sf):
    ratio = metrics.windowed_ratio(_latencies(spark, sf), "event_type IN ('error', 'click')", "1 hour")
    return metrics.hold_for(metrics.firing(ratio, "ratio", 0.25), 7200, step_s=3600)


@query(f"WITH {RATIO} SELECT * FROM held")
def high_attack_rate(spark, sf):
    return _micros(_high_ratio(spark, sf))


@query(f"WITH {_hold_sql('sum(value) / count(*)', '50', 3_600_000_000, 10_800_000_000)} SELECT * FROM held")
def high_latency(spark, sf):
    average = metrics.windowed_average(_latencies(spark, sf), "latency_ms", "1 hour")
    return _micros(metrics.hold_for(metrics.firing(average, "average", 50), 10_800, step_s=3600))


@query("""WITH g AS (SELECT event_type AS source, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events)
SELECT source, p AS from_us, p + 7200000000 AS fired_us, us AS until_us FROM g WHERE us - p > 7200000000
UNION ALL SELECT event_type, max(epoch_us(ts)), max(epoch_us(ts)) + 7200000000, epoch_us(TIMESTAMP '2024-02-01') FROM events GROUP BY 1""")
def silent_sources(spark, sf):
    gaps = metrics.absence(_latencies(spark, sf).withColumnRenamed("event_type", "source"), 7200, now="2024-02-01 00:00:00")
    return gaps.select("source", us("silent_from").alias("from_us"), us("fired").alias("fired_us"), us("silent_until").alias("until_us"))


# -- streams and models ------------------------------------------------------------------------


# The stream's clock is the end of the last time bucket that the watermark, a minute behind the newest packet, has passed.
@query(f"""WITH RECURSIVE {FLOW_CTE},
clock AS (SELECT (max(us) // 1000 - 60000) // 2700000 * 2700000000 AS passed FROM keyed)
SELECT flow_id, src_ip, dst_ip, src_port, dst_port, start_us, last_us, packets, bytes,
 CASE WHEN close_reason = 'flush' AND passed > least(last_us + 21600000000, start_us + 43200000000)
  THEN CASE WHEN last_us + 21600000000 <= start_us + 43200000000 THEN 'idle_timeout' ELSE 'absolute_timeout' END
  ELSE close_reason END AS close_reason FROM flows, clock""")
def streamed_flows(spark, sf):
    """Packets as a stream to its end, then the flush of what is still open."""
    from netloom.operators.stages import shared_folder
    from netloom.streaming.flows import assemble_stream, flush_open_flows

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    stream = assemble_stream(views.events_stream(spark, sf), FLOWS, "1 minute")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    q.start().awaitTermination()
    done = spark.read.parquet(f"{folder}/out").drop("batch")
    rest = flush_open_flows(spark, f"{folder}/state", FLOWS).select(done.columns)
    flows = flow_table(done.unionByName(rest), FLOWS)
    return flows.select(
        "flow_id", "src_ip", "dst_ip", "src_port", "dst_port", us("start").alias("start_us"), us("last").alias("last_us"),
        "packets", "bytes", "close_reason",
    )


# A third of the events pass the gates of a stream; the seconds keep repeats within a window of a day.
@query(f"""WITH RECURSIVE gated AS (SELECT flow_id, epoch_us(ts) AS us, src_ip, dst_ip, class_name AS attack_type FROM ({views.SCORED_SQL}) WHERE rf > 0.66),
o AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, attack_type ORDER BY us, flow_id) AS rn,
  dense_rank() OVER (ORDER BY src_ip, dst_ip, attack_type) AS kid FROM gated),
w AS (SELECT kid, rn, flow_id, us AS anchor, true AS is_first FROM o WHERE rn = 1
 UNION ALL SELECT o.kid, o.rn, o.flow_id, CASE WHEN o.us - w.anchor >= 86400000000 THEN o.us ELSE w.anchor END, o.us - w.anchor >= 86400000000
 FROM w JOIN o ON o.kid = w.kid AND o.rn = w.rn + 1)
SELECT flow_id, is_first, anchor AS anchor_us FROM w""")
def streamed_dedup(spark, sf):
    """Alerts as a stream to its end, then those that still waited."""
    from netloom.streaming.dedup import dedup_stream, flush_waiting_alerts

    folder = _folder(spark, "dedup")
    events = views.events_stream(spark, sf, views.SCORED_SQL)
    alerts = events.where("rf > 0.66").selectExpr("flow_id", "ts", "src_ip", "dst_ip", "class_name AS attack_type")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = dedup_stream(alerts, DEDUP_S, delay="1 minute").writeStream.foreachBatch(write)
    q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{folder}/out").select("flow_id", "is_first", "anchor_us")
    rest = flush_waiting_alerts(spark, f"{folder}/state", DEDUP_S)
    return done.unionByName(rest.select("flow_id", "is_first", us("anchor_ts").alias("anchor_us")))


# What a stream a minute behind its newest event has closed.
_CLOSED = "(SELECT (max(epoch_us(ts)) // 1000 - 60000) * 1000 FROM events)"


def _streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream emits until its input ends."""
    from netloom.streaming.detect import write_once

    folder = _folder(spark, name)
    q = stream.writeStream.foreachBatch(lambda batch, batch_id: write_once(batch, batch_id, f"{folder}/out"))
    q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/batch=*")


def _event_stream(spark, sf):
    return views.events_stream(spark, sf, "SELECT ts, event_type, value AS latency_ms FROM events")


@query(f"{SQL['hourly_increase']} HAVING e * 300000000 <= {_CLOSED}")
def streamed_increase(spark, sf):
    from netloom.streaming.monitor import increase_stream

    found = _streamed(spark, increase_stream(_event_stream(spark, sf), "1 hour", "5 minutes", "event_type = 'error'", "1 minute"), "increase")
    return found.select(us("ts").alias("us"), "increase")


@query(f"WITH {RATIO.replace('FROM events GROUP BY 1)', f'FROM events WHERE epoch_us(ts) // 3600000000 * 3600000000 + 3600000000 <= {_CLOSED} GROUP BY 1)')} SELECT 'firing' AS event, started_us, fired_us FROM held")
def streamed_attack_rate(spark, sf):
    """A rule over closed windows of a stream, held for two hours."""
    from netloom.streaming.monitor import hold_stream, ratio_stream

    ratio = ratio_stream(_event_stream(spark, sf), "event_type IN ('error', 'click')", "1 hour", "1 minute")
    found = _streamed(spark, hold_stream(metrics.firing(ratio, "ratio", 0.25), 7200, 3600, "attack rate"), "rule")
    return found.where("event = 'firing'").select("event", "started_us", "fired_us")


@query(f"{SQL['daily_counters']} HAVING window_us + 86400000000 <= {_CLOSED}")
def streamed_counters(spark, sf):
    from netloom.streaming.monitor import counters_stream

    scored = scoring.score_stacking(views.events_stream(spark, sf, views.SCORED_SQL))
    c = _streamed(spark, counters_stream(scored, "1 day", "1 minute"), "counters").drop("window_end")
    return r6(c.withColumn("window_us", us("window_start")).drop("window_start"), "attack_rate")


# -- sources and sinks: written to the shared folder, read back ----------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    from netloom.operators.stages import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT l_returnflag AS label, count(*) AS rows, count(CASE WHEN l_linenumber % 3 <> 0 THEN 1 END) AS qty_n,
 round(sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 4) AS qty_sum, count(CASE WHEN l_linenumber % 4 <> 0 THEN 1 END) AS port_n,
 CAST(sum(CASE WHEN l_linenumber % 4 <> 0 THEN l_linenumber END) AS BIGINT) AS port_sum FROM lineitem GROUP BY 1""")
def csv_files(spark, sf):
    """Files with untrimmed and swapped headers, infinite and oversized numbers."""
    from pyspark.sql import types as T

    from netloom.sources.tables import read_flow_csvs

    li, folder = views.table(spark, sf, "lineitem"), _folder(spark, "csv")
    qty = F.when(F.col("l_linenumber") % 3 == 0, F.lit("Infinity")).otherwise(F.col("l_quantity").cast("string"))
    port = F.when(F.col("l_linenumber") % 4 == 0, F.when(F.col("l_linenumber") == 4, "NaN").otherwise("9e99")).otherwise(F.col("l_linenumber").cast("string"))
    rows = li.select(qty.alias(" Quantity "), port.alias("Port"), F.col("l_returnflag").alias(" Label"), "l_orderkey")
    half = F.col("l_orderkey") % 2 == 0
    rows.where(half).drop("l_orderkey").write.option("header", True).csv(f"{folder}/a")
    rows.where(~half).drop("l_orderkey").select(" Label", "Port", " Quantity ").write.option("header", True).csv(f"{folder}/b")
    schema = T.StructType().add("Port", T.IntegerType()).add("Quantity", T.DoubleType()).add("Label", T.StringType())
    back = read_flow_csvs(spark, f"{folder}/*", schema)
    return back.groupBy(F.col("Label").alias("label")).agg(
        F.count("*").alias("rows"), F.count("Quantity").alias("qty_n"), F.round(F.sum("Quantity"), 4).alias("qty_sum"),
        F.count("Port").alias("port_n"), F.sum("Port").alias("port_sum"),
    )


@query("SELECT l_linestatus AS source_file, count(*) AS rows FROM lineitem GROUP BY 1")
def clean_files(spark, sf):
    from netloom.sources.tables import write_clean

    folder = _folder(spark, "clean")
    write_clean(_files(spark, sf), folder)
    return spark.read.parquet(folder).groupBy("source_file").agg(F.count("*").alias("rows"))


@query("""WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1)
SELECT label, n - CAST(round(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS n FROM c""")
def split_tables(spark, sf):
    """One split read back from the partitioned table."""
    from netloom.sources.tables import read_split, write_split

    folder = _folder(spark, "split")
    write_split(splits.stratified_split(views.labelled_rows(spark, sf), "label", {"train": 0.8, "test": 0.2}), folder)
    return read_split(spark, folder, "test", ["label"]).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS label, count(*) AS rows FROM lineitem GROUP BY 1")
def report_files(spark, sf):
    from netloom.sources.tables import write_report

    folder = _folder(spark, "report")
    counts = views.labelled_rows(spark, sf).groupBy("label").agg(F.count("*").alias("rows"))
    write_report(counts, f"{folder}/csv", "csv")
    write_report(counts, f"{folder}/json")
    back = spark.read.schema(counts.schema).option("header", True).csv(f"{folder}/csv")
    return back.join(spark.read.schema(counts.schema).json(f"{folder}/json"), ["label", "rows"])


@query(f"""WITH RECURSIVE {RAISED} SELECT CAST(us // 86400000000 AS BIGINT) AS day, attack_type, severity, count(*) AS alerts,
 round(sum(meta_probability), 4) AS probability FROM raised GROUP BY ALL""")
def alert_table(spark, sf):
    """Stored twice as one batch, as a replay would, and read back."""
    from netloom.sources.alerts import append_alerts, read_alerts, to_alert_rows

    folder, rows = _folder(spark, "alerts"), to_alert_rows(_alerts(spark, sf))
    append_alerts(rows, folder, 7)
    append_alerts(rows, folder, 7)
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    return read_alerts(spark, folder).groupBy(day.alias("day"), "attack_type", "severity").agg(
        F.count("*").alias("alerts"), F.round(F.sum("meta_probability"), 4).alias("probability")
    )


@query(f"WITH {SCORED} SELECT attack_type, count(*) AS flows FROM scored GROUP BY 1")
def early_exit_scores(spark, sf):
    """The class model sees known attacks only; the verdict is that of all rows scored."""
    base = views.scored_inputs(spark, sf)
    judged = scoring.score_stacking(base).withColumn("_unknown", F.col("attack_type") == "UNKNOWN_ATTACK")
    narrow = judged.select("flow_id", "is_attack", "_unknown")
    names = base.select(F.col("flow_id").alias("of"), "class_name", "class_confidence")
    classified = scoring.early_exit(narrow, lambda known: known.join(names, F.col("flow_id") == F.col("of")).drop("of"))
    kind = F.when(~F.col("is_attack"), "BENIGN").when(F.col("_unknown"), "UNKNOWN_ATTACK").otherwise(F.col("class_name"))
    return classified.groupBy(kind.alias("attack_type")).agg(F.count("*").alias("flows"))


def fitted_on_flows(spark, sf):
    """A small stack trained on the flows of the packets, labelled by their flags."""
    from netloom.plans.training import TrainingParams, train

    flows = flow_features(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS)
    label = F.when(F.col("`SYN Flag Count`") > 0, "PortScan").when(F.col("`FIN Flag Count`") > 0, "DDoS").otherwise("BENIGN")
    flows = settle(flows.withColumn("label", label), "flows")
    sizes = TrainingParams(forest=SMALL, boosted={"maxIter": 5, "maxDepth": 4}, classes=SMALL, isolation={"numTrees": 40})
    rows = flows.select("label", *(F.col(f"`{c}`") for c in TRAINED_ON))
    return train(rows, TRAINED_ON, params=sizes)[0], flows


TRAINED_ON = ["Flow Packets/s", "Packet Length Mean", "Flow Duration", "SYN Flag Count", "FIN Flag Count"]


@query(f"""WITH RECURSIVE {FLOW_CTE}, l AS (SELECT flow_id, CASE WHEN count(CASE WHEN (tcp_flags & 2) <> 0 THEN 1 END) > 0 THEN 'PortScan'
  WHEN count(CASE WHEN (tcp_flags & 1) <> 0 THEN 1 END) > 0 THEN 'DDoS' ELSE 'BENIGN' END AS label FROM fp GROUP BY 1)
SELECT label, count(*) AS flows, CAST(0 AS BIGINT) AS inconsistent, true AS learned FROM l GROUP BY 1""")
def trained_detection(spark, sf):
    """Packets to flows to trained, stored and reloaded models to outcomes.

    ``learned``: at least nine in ten flows of a label, most of them not fitted on, are judged right.
    """
    from netloom.operators.alerts import decide
    from netloom.plans.detection import score_flows
    from netloom.plans.training import FittedStack

    fitted, flows = fitted_on_flows(spark, sf)
    folder = _folder(spark, "stack")
    fitted.save(spark, folder)
    stack = FittedStack.load(spark, folder)
    params = DetectionParams(flows=FLOWS, scores=stack.params, alerts=AlertParams(dedup_window_s=DEDUP_S))
    decided = decide(score_flows(flows, stack.flow_scores, params), params.alerts)
    wrong = (F.col("is_attack") != (F.col("meta_probability") >= params.scores.meta_threshold)) | F.col("outcome").isNull() | (
        F.col("is_attack") == (F.col("attack_type") == "BENIGN")
    )
    truth = flows.select(F.col("flow_id").alias("of"), "label")
    joined = decided.join(truth, F.col("flow_id") == F.col("of"))
    right = F.avg((F.col("is_attack") == (F.col("label") != "BENIGN")).cast("int")) >= 0.9
    return joined.groupBy("label").agg(
        F.count("*").alias("flows"), F.count(F.when(wrong, 1)).alias("inconsistent"), right.alias("learned")
    )


@query(SQL["trained_detection"].replace("CAST(0 AS BIGINT) AS inconsistent, ", ""))
def softmax_boosting(spark, sf):
    """Second-order boosting of all classes, fitted on half of the flows.

    ``learned``: at least nine in ten of a label's other flows get their class, and the loss is below a quarter of that of the class shares.
    """
    from netloom.operators.boosting import BoostParams, train_boosted

    flows = flow_features(assemble_flows(views.packets(spark, sf), FLOWS), FLOWS)
    kind = F.when(F.col("`SYN Flag Count`") > 0, 2).when(F.col("`FIN Flag Count`") > 0, 1).otherwise(0)
    rows = flows.select("flow_id", kind.alias("y"), *(F.col(f"`{c}`") for c in TRAINED_ON))
    rows = settle(rows.withColumn("fit", F.pmod(F.xxhash64("flow_id"), F.lit(2)) == 0), "boost-flows")
    sizes = BoostParams(rounds=6, depth=3, eta=0.5, bins=32)
    model = train_boosted(rows.where("fit"), TRAINED_ON, "y", 3, sizes)
    scored = settle(model.transform(rows), "boost-scores")
    held = scored.where("NOT fit").withColumn("loss", -F.log(F.greatest(F.get("boost_vec", F.col("y")), F.lit(1e-12))))
    total = held.agg(F.avg("loss").alias("loss")).first().loss
    shares = held.groupBy("y").count().collect()
    n = sum(r["count"] for r in shares)
    plain = -sum(r["count"] / n * math.log(r["count"] / n) for r in shares)
    right = held.groupBy("y").agg((F.avg((F.col("boost_pred") == F.col("y")).cast("int")) >= 0.9).alias("right"))
    names = F.element_at(F.array(F.lit("BENIGN"), F.lit("DDoS"), F.lit("PortScan")), F.col("y") + 1)
    counts = scored.groupBy("y").agg(F.count("*").alias("flows"))
    return counts.join(right, "y").select(names.alias("label"), "flows", (F.col("right") & F.lit(total < plain / 4)).alias("learned"))


SMALL = {"numTrees": 10, "maxDepth": 5}


def _fit(spark, sf):
    from netloom.plans.training import TrainingParams, train

    params = TrainingParams(
        forest=SMALL, boosted={"maxIter": 5, "maxDepth": 4}, classes=SMALL, isolation={"numTrees": 40}, benign="N"
    )
    return train(views.labelled_rows(spark, sf).select("label", *FEATURES), FEATURES, params=params)


@query()
def trained_stack(spark, sf):
    """Split, fit every model, score the test split."""
    stack, parts = _fit(spark, sf)
    scored = stack.score(parts.where("split = 'test'").select("label", "attack", *FEATURES))
    return scored.groupBy("label", "attack_type", "severity").agg(
        F.count("*").alias("n"), F.round(F.avg("meta_probability"), 6).alias("meta_probability")
    )


def _with_medians(df):
    medians = clean.global_medians(clean.normalise_missing(df), FEATURES).first().asDict()
    return clean.impute_at_inference(df, {c: m for c, m in medians.items() if m is not None}, FEATURES)


@query()
def isolation_scores(spark, sf):
    """Isolation forest fitted on one class, scored on all rows."""
    from netloom.operators.isolation import IsolationForest

    df = _with_medians(views.labelled_rows(spark, sf))
    scale = clean.fit_standardiser(df.where("label = 'N'"), FEATURES)
    rows = df.withColumn("scaled", F.array(*((F.col(c) - m) / s for c, (m, s) in scale.items())))
    scored = IsolationForest(numTrees=50).fit(rows.where("label = 'N'")).transform(rows)
    return scored.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.min("iso_decision"), 6).alias("low"), F.round(F.max("iso_decision"), 6).alias("high")
    )


@query()
def important_features(spark, sf):
    from netloom.operators import models

    df = clean.binary_label(views.labelled_rows(spark, sf), benign="N")
    rows = models.assemble(_with_medians(df), FEATURES)
    forest = models.train_random_forest(rows, **SMALL)
    boosted = models.train_boosted_binary(rows, maxIter=5, maxDepth=4)
    table = models.feature_importance(spark, {"xgb": boosted, "rf": forest}, FEATURES)
    return models.top_features(table, "xgb_importance", 20)
