"""Packet tables and streams, and raw frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.schema import PACKET_SCHEMA


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def packet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Unbounded packets from a directory of Parquet files; ``max_files`` paces each batch."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


# Ethernet types of VLAN tags.
VLAN_TAGS = (0x8100, 0x88A8)


def _uint(at: Column | int, width: int) -> Column:
    """Big-endian unsigned number at a 1-based byte position of the frame."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(F.col("frame"), at, F.lit(width))), 16, 10).cast("int")


def decode_frames(frames: DataFrame, link_header: int = 14) -> DataFrame:
    """Raw frames (``packet_id, ts, frame``) to packets; other than IPv4 TCP/UDP/ICMP is dropped.

    ``link_header`` is the length before the IP header (14 for Ethernet, 0 for raw IP); up to two VLAN tags
    behind it are skipped.  A fragment other than the first holds no transport header and is dropped.
    Only byte arithmetic on columns, so bulk decoding stays inside generated code.
    """
    size = F.length("frame")
    df = frames.where(size >= link_header + 20)
    if link_header >= 14:
        kind = link_header - 1
        tagged = lambda at: _uint(at, 2).isin(*VLAN_TAGS)
        tags = F.when(~tagged(kind), 0).when(~tagged(kind + 4), 4).otherwise(8)
        df = df.withColumn("_link", tags + link_header)
        df = df.where((size >= F.col("_link") + 20) & (_uint(F.col("_link") - 1, 2) == 0x0800))
    else:
        df = df.withColumn("_link", F.lit(link_header))
    ip = F.col("_link") + 1
    df = df.withColumns({"_b0": _uint(ip, 1), "protocol": _uint(ip + 9, 1), "_fragment": _uint(ip + 6, 2)})
    df = df.where((F.shiftright("_b0", 4) == 4) & F.col("protocol").isin(1, 6, 17))
    df = df.where(F.col("_fragment").bitwiseAND(0x1FFF) == 0)
    df = df.withColumn("_ihl", F.col("_b0").bitwiseAND(0x0F) * 4)
    l4 = F.col("_ihl") + ip
    tcp, ported = F.col("protocol") == 6, F.col("protocol") != 1
    # A header cut off by the capture is not a packet of that protocol.
    need = F.when(tcp, 20).otherwise(8)
    df = df.where(size >= F.col("_ihl") + need + F.col("_link"))

    def address(at: Column) -> Column:
        return F.concat_ws(".", *(_uint(at + i, 1).cast("string") for i in range(4)))

    flags = F.when(tcp, _uint(l4 + 13, 1)).otherwise(0)
    return df.select(
        "packet_id",
        "ts",
        address(ip + 12).alias("src_ip"),
        address(ip + 16).alias("dst_ip"),
        F.when(ported, _uint(l4, 2)).otherwise(0).alias("src_port"),
        F.when(ported, _uint(l4 + 2, 2)).otherwise(0).alias("dst_port"),
        "protocol",
        size.alias("length"),
        (F.col("_ihl") + F.when(tcp, F.shiftright(_uint(l4 + 12, 1), 4) * 4).otherwise(8)).alias("header_len"),
        flags.alias("tcp_flags"),
        F.when(tcp, _uint(l4 + 14, 2)).otherwise(0).alias("window_size"),
    )
