"""The streaming detection plan: packets to predictions to alerts.

Two queries joined by the predictions table, since each holds its own keyed state:
flows are keyed by endpoint pair, dedup by (source, target, type).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.config import DetectionParams
from netloom.operators.alerts import alert_rules, notification_queue
from netloom.operators.features import flow_features
from netloom.plans.detection import score_flows
from netloom.sources.alerts import append_alerts, to_alert_rows
from netloom.streaming.dedup import dedup_stream, flush_waiting_alerts
from netloom.streaming.flows import assemble_stream, flush_open_flows

Scores = Callable[[DataFrame], DataFrame]
#: The batch number of what is still open when a run ends.  These rows are provisional: the next run removes them and
#: goes on from the state, so a flow that packets of a later run prolong, or an alert that they precede, comes out whole.
FLUSH = -1


def _committed(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_provisional(spark: SparkSession, folder: str) -> None:
    """Remove what the last run under ``folder`` wrote for flows and alerts that were still open."""
    for pattern in (f"{folder}/predictions/batch={FLUSH}", f"{folder}/notices/batch={FLUSH}", f"{folder}/alerts/date=*/batch={FLUSH}"):
        glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        files = glob.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(glob) or []:
            files.delete(found.getPath(), True)


def write_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """Each micro-batch has its own directory; a replayed batch is not written twice."""
    target = f"{path}/batch={batch_id}"
    if not _committed(batch.sparkSession, target):
        batch.write.mode("overwrite").parquet(target)


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def predict_stream(
    packets: DataFrame, out: str, checkpoint: str, base_scores: Scores, params: DetectionParams = DetectionParams(),
    every: str | None = None, delay: str = "10 seconds",
) -> StreamingQuery:
    """Packets to scored flows in ``out``; finished flows are scored per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # One row per flow from here on; the batch is small next to the packets.
        features = flow_features(batch, params.flows)
        write_once(score_flows(features, base_scores, params), batch_id, out)

    flows = assemble_stream(packets, params.flows, delay)
    writer = flows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def _store_alerts(decided: DataFrame, batch_id: int, alerts_path: str, notices_path: str | None, params: DetectionParams) -> None:
    """First alerts of their windows to the table and the messages; the batch is evaluated once."""
    alerts = to_alert_rows(decided.where("is_first")).persist()
    try:
        append_alerts(alerts, alerts_path, batch_id)
        if notices_path:
            write_once(notification_queue(alerts, params.alerts.notify_min_severity), batch_id, notices_path)
    finally:
        alerts.unpersist()


def _alert_rows(predictions: DataFrame, params: DetectionParams) -> DataFrame:
    """Predictions that pass the gates."""
    ruled = alert_rules(predictions, params.alerts).where(F.col("suppress_reason").isNull())
    # Gates that passed leave no reason; the rest of the row travels through the state.
    return ruled.drop("suppress_reason", "error", "start")


def alert_stream(
    predictions: DataFrame, alerts_path: str, checkpoint: str, params: DetectionParams = DetectionParams(),
    notices_path: str | None = None, every: str | None = None, delay: str = "10 seconds",
) -> StreamingQuery:
    """Scored flows to stored alerts and, from a severity on, message rows."""
    deduped = dedup_stream(_alert_rows(predictions, params), params.alerts.dedup_window_s, delay=delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        _store_alerts(batch, batch_id, alerts_path, notices_path, params)

    writer = deduped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def run_detection(
    spark: SparkSession, packets: DataFrame, folder: str, base_scores: Scores, params: DetectionParams = DetectionParams(),
    every: str | None = None, delay: str = "10 seconds",
) -> list[StreamingQuery]:
    """Start both queries under ``folder``, or go on where an earlier run there has ended.

    Without ``every`` all available packets are processed and both queries end.  What is then still open (unfinished flows, alerts
    that wait for the watermark) is finished as if no packet followed and stored as batch ``FLUSH`` beside the
    others; the state keeps it, and the next run replaces those rows.  After every run the tables equal the batch plan
    over all packets so far, apart from packets later than ``delay``.
    """
    predictions, chk = f"{folder}/predictions", f"{folder}/checkpoints"
    drop_provisional(spark, folder)
    first = predict_stream(packets, predictions, f"{chk}/flows", base_scores, params, every, delay)
    schema = prediction_schema(spark, params, base_scores)
    if every is None:
        first.awaitTermination()
    scored = spark.readStream.schema(schema).parquet(f"{predictions}/batch=[0-9]*")
    second = alert_stream(scored, f"{folder}/alerts", f"{chk}/alerts", params, f"{folder}/notices", every, delay)
    if every is None:
        second.awaitTermination()
        rest = flow_features(flush_open_flows(spark, f"{chk}/flows", params.flows), params.flows)
        write_once(score_flows(rest, base_scores, params), FLUSH, predictions)
        unfinished = spark.read.schema(schema).parquet(f"{predictions}/batch={FLUSH}")
        waiting = flush_waiting_alerts(
            spark, f"{chk}/alerts", params.alerts.dedup_window_s, more=_alert_rows(unfinished, params)
        )
        _store_alerts(waiting, FLUSH, f"{folder}/alerts", f"{folder}/notices", params)
    return [first, second]


def prediction_schema(spark: SparkSession, params: DetectionParams, base_scores) -> "T.StructType":
    """Schema of the predictions table, from the plan alone."""
    from netloom.streaming.flows import FLOW_PACKETS

    empty = spark.createDataFrame([], FLOW_PACKETS)
    return score_flows(flow_features(empty, params.flows), base_scores, params).schema


def attack_sink(predictions: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Attacks as JSON lines, appended as they are scored."""
    from netloom.operators.alerts import attack_feed

    writer = attack_feed(predictions).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()
