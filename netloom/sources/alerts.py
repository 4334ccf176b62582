"""The alert table: append-only Parquet, one directory per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.schema import ALERT_ADDED_COLUMNS, ALERT_SCHEMA


def to_alert_rows(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Alert columns in table order.

    The id is a hash of what makes an alert unique; a global counter would need one task.
    """
    ident = F.xxhash64(F.col(ts), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "attack_type")
    rows = alerts.withColumns({"id": ident, "timestamp": F.col(ts).cast("timestamp")})
    if "latency_ms" not in rows.columns:
        rows = rows.withColumn("latency_ms", F.lit(0.0))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA))


def append_alerts(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append alerts partitioned by day.

    With ``batch_id`` (from ``foreachBatch``) the batch owns its directories below each day and
    a replay overwrites them, so a failed and repeated batch stores each alert once.  A
    day's alerts are few; they go to one file per batch.
    """
    rows = alerts.withColumn("date", F.to_date("timestamp"))
    if batch_id is None:
        rows.write.mode("append").partitionBy("date").parquet(path)
        return
    rows = rows.withColumn("batch", F.lit(batch_id).cast("long")).repartition("date")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of every release; score columns an old file lacks read as 0.0.

    The schema is given, so no file footer is merged; a column that a file lacks reads as
    NULL.  A filter on ``date`` prunes directories.
    """
    schema = T.StructType([*ALERT_SCHEMA, T.StructField("date", T.DateType())])
    return evolve_alert_schema(spark.read.schema(schema).parquet(path))


def evolve_alert_schema(alerts: DataFrame) -> DataFrame:
    """Add missing score columns and fill them with 0.0."""
    for name in ALERT_ADDED_COLUMNS:
        column = F.coalesce(F.col(name), F.lit(0.0)) if name in alerts.columns else F.lit(0.0)
        alerts = alerts.withColumn(name, column)
    extra = [c for c in ("date",) if c in alerts.columns]
    return alerts.select(*ALERT_SCHEMA.names, *extra)
