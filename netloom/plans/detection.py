"""The batch detection plan: packets to alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.config import DetectionParams
from netloom.operators.alerts import decide
from netloom.operators.features import flow_features
from netloom.operators.flows import assemble_flows
from netloom.operators.scoring import PREDICTION_COLUMNS, score_stacking

FLOW_COLUMNS = ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start", "ts", "close_reason")


def detect(
    packets: DataFrame, base_scores: Callable[[DataFrame], DataFrame], params: DetectionParams = DetectionParams()
) -> DataFrame:
    """Flows, features, scores, gates and dedup; one row per flow with its ``outcome``.

    ``base_scores`` adds ``rf``, ``xgb``, ``iso``, ``class_name`` and ``class_confidence`` to the
    feature rows, as ``FittedStack.flow_scores`` does; a column ``meta`` (a fitted
    meta-learner's probability) takes the place of the weights in ``params``.
    """
    features = flow_features(assemble_flows(packets, params.flows), params.flows)
    return decide(score_flows(features, base_scores, params), params.alerts)


def score_flows(
    features: DataFrame, base_scores: Callable[[DataFrame], DataFrame], params: DetectionParams = DetectionParams()
) -> DataFrame:
    """Predictions of feature rows, without the features: dedup must not shuffle those."""
    based = base_scores(features)
    scored = score_stacking(based, params.scores, meta="meta" if "meta" in based.columns else None)
    if "latency_ms" not in scored.columns:
        scored = scored.withColumn("latency_ms", F.lit(0.0))
    return scored.withColumnRenamed("last", "ts").select(*FLOW_COLUMNS, *PREDICTION_COLUMNS)
