"""Schemas and fixed names shared by every operator.

Schemas are always explicit: nothing in the package infers types from data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The feature names a trained model expects, in model order.
FEATURE_NAMES: tuple[str, ...] = (
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Backward Packets",
    "Total Length of Fwd Packets",
    "Total Length of Bwd Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Fwd Packet Length Std",
    "Bwd Packet Length Max",
    "Bwd Packet Length Min",
    "Bwd Packet Length Mean",
    "Bwd Packet Length Std",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Total",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Max",
    "Fwd IAT Min",
    "Bwd IAT Total",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd PSH Flags",
    "Bwd PSH Flags",
    "Fwd URG Flags",
    "Bwd URG Flags",
    "Fwd Header Length",
    "Bwd Header Length",
    "Fwd Packets/s",
    "Bwd Packets/s",
    "Min Packet Length",
    "Max Packet Length",
    "Packet Length Mean",
    "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count",
    "SYN Flag Count",
    "RST Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "URG Flag Count",
    "CWE Flag Count",
    "ECE Flag Count",
    "Down/Up Ratio",
    "Average Packet Size",
    "Avg Fwd Segment Size",
    "Avg Bwd Segment Size",
    "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk",
    "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk",
    "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets",
    "Subflow Fwd Bytes",
    "Subflow Bwd Packets",
    "Subflow Bwd Bytes",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Std",
    "Active Max",
    "Active Min",
    "Idle Mean",
    "Idle Std",
    "Idle Max",
    "Idle Min",
)

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG, ECE_BIT, CWE_BIT = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x80, 0x40

# IP protocol numbers and their display names.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}

# Severity order.
SEVERITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

# Base severity of each attack class.
BASE_SEVERITY = {
    "DDoS": "CRITICAL",
    "DoS Hulk": "CRITICAL",
    "DoS GoldenEye": "CRITICAL",
    "DoS slowloris": "CRITICAL",
    "DoS Slowhttptest": "CRITICAL",
    "Heartbleed": "CRITICAL",
    "SSH-Patator": "HIGH",
    "FTP-Patator": "HIGH",
    "Web Attack – Brute Force": "HIGH",
    "Web Attack – XSS": "HIGH",
    "Web Attack – Sql Injection": "HIGH",
    "Web Attack - Brute Force": "HIGH",
    "Web Attack - XSS": "HIGH",
    "Web Attack - Sql Injection": "HIGH",
    "Infiltration": "HIGH",
    "Bot": "MEDIUM",
    "PortScan": "MEDIUM",
    "UNKNOWN_ATTACK": "CRITICAL",
}

# Histogram bucket bounds, in milliseconds.
INFERENCE_BUCKETS_MS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)
FEATURE_BUCKETS_MS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("packet_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("src_port", T.IntegerType(), False),
        T.StructField("dst_port", T.IntegerType(), False),
        T.StructField("protocol", T.IntegerType(), False),
        T.StructField("length", T.IntegerType(), False),
        T.StructField("header_len", T.IntegerType(), False),
        T.StructField("tcp_flags", T.IntegerType(), False),
        T.StructField("window_size", T.IntegerType(), False),
    ]
)

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("packet_id", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("frame", T.BinaryType(), True),
    ]
)

# Training CSV: the port is a 16-bit unsigned number, every other feature 32-bit float.
FLOW_CSV_SCHEMA = T.StructType(
    [T.StructField("Destination Port", T.IntegerType(), True)]
    + [T.StructField(n, T.FloatType(), True) for n in FEATURE_NAMES[1:]]
    + [T.StructField("Label", T.StringType(), True)]
)

# Score columns that a stored alert may lack when it was written by an older release.
ALERT_ADDED_COLUMNS = ("rf_probability", "xgb_probability", "meta_probability")

# Names, order and types of the alert table's columns.
ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("src_port", T.IntegerType(), False),
        T.StructField("dst_port", T.IntegerType(), False),
        T.StructField("protocol", T.IntegerType(), False),
        T.StructField("attack_type", T.StringType(), False),
        T.StructField("attack_probability", T.DoubleType(), False),
        T.StructField("rf_probability", T.DoubleType(), False),
        T.StructField("xgb_probability", T.DoubleType(), False),
        T.StructField("meta_probability", T.DoubleType(), False),
        T.StructField("attack_confidence", T.DoubleType(), False),
        T.StructField("iso_score", T.DoubleType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("latency_ms", T.DoubleType(), False),
    ]
)
