"""From base-model scores to a decision: stacking, unknown check, class, severity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.config import ScoreParams
from netloom.functions.severity import severity_by_type
from netloom.operators.stages import settle

PREDICTION_COLUMNS = (
    "is_attack", "attack_probability", "rf_probability", "xgb_probability", "meta_probability",
    "attack_type", "attack_confidence", "iso_score", "severity", "latency_ms", "error",
)


def fit_anomaly_range(df: DataFrame, decision: str = "iso_decision") -> tuple[float, float]:
    """Range of the negated decision value; one aggregate row."""
    row = df.agg(F.min(-F.col(decision)).alias("lo"), F.max(-F.col(decision)).alias("hi")).first()
    if row.lo is None or row.hi <= row.lo:
        raise ValueError(f"invalid anomaly range: {row.lo} .. {row.hi}")
    return row.lo, row.hi


def normalise_anomaly(decision: Column, params: ScoreParams = ScoreParams(), clip: bool = True) -> Column:
    """Negated decision scaled by the fitted range; clipped to [0, 1] at inference."""
    width = params.iso_max - params.iso_min + 1e-10
    scaled = (-decision - F.lit(params.iso_min)) / F.lit(width)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) if clip else scaled


def meta_probability(rf: Column, xgb: Column, iso: Column, params: ScoreParams = ScoreParams()) -> Column:
    """Logistic combination of the three base scores."""
    z = F.lit(params.intercept) + F.lit(params.w_rf) * rf + F.lit(params.w_xgb) * xgb + F.lit(params.w_iso) * iso
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def input_error(df: DataFrame, required: Sequence[str]) -> Column:
    """NULL for a good row, else a message naming the first missing inputs."""
    missing = F.filter(
        F.array(*(F.when(F.col(f"`{c}`").cast("double").isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull()
    )
    text = F.concat(
        F.size(missing).cast("string"),
        F.lit(" missing feature(s): "),
        F.array_join(F.slice(missing, 1, 5), ", "),
        F.when(F.size(missing) > 5, " ...").otherwise(""),
    )
    return F.when(F.size(missing) > 0, text)


def text_to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Untrusted text columns to numbers; text that is no number becomes NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def score_stacking(
    df: DataFrame,
    params: ScoreParams = ScoreParams(),
    *,
    rf: str = "rf",
    xgb: str = "xgb",
    iso: str = "iso",
    meta: str | None = None,
    class_name: str = "class_name",
    class_confidence: str = "class_confidence",
    decision: str = "stacking",
) -> DataFrame:
    """Add the prediction columns to rows that carry base scores.

    ``meta`` names a column with a fitted meta-learner's probability; without it the
    weights in ``params`` are used.  ``decision="single"`` uses the boosted score alone
    against ``binary_threshold``.  A row with a missing score gets ``error`` and is
    no attack; other rows are not affected.
    """
    if decision not in ("stacking", "single"):
        raise ValueError("decision must be 'stacking' or 'single'")
    r, x, i = (F.col(c).cast("double") for c in (rf, xgb, iso))
    prob = F.col(meta).cast("double") if meta else meta_probability(r, x, i, params)
    out = df.withColumns({"error": input_error(df, [rf, xgb, iso] + ([meta] if meta else [])), "_p": prob})
    p, ok = F.col("_p"), F.col("error").isNull()
    fires = p >= params.meta_threshold if decision == "stacking" else x >= params.binary_threshold
    out = out.withColumn("is_attack", ok & F.coalesce(fires, F.lit(False)))
    unknown = F.col("is_attack") & (i >= params.unknown_iso_threshold)
    out = out.withColumn("_unknown", F.coalesce(unknown, F.lit(False)))
    return with_verdict(out, r, x, i, p, F.col(class_name), F.col(class_confidence)).drop("_p", "_unknown")


def with_verdict(df: DataFrame, rf, xgb, iso, prob, name: Column, confidence: Column) -> DataFrame:
    """Class, confidence and severity from ``is_attack`` and ``_unknown``."""
    attack, unknown, ok = F.col("is_attack"), F.col("_unknown"), F.col("error").isNull()

    def score(c: Column) -> Column:
        return F.when(ok, F.round(c, 6)).otherwise(0.0)

    attack_type = F.when(~attack, "BENIGN").when(unknown, "UNKNOWN_ATTACK").otherwise(name)
    deciding = F.when(~attack, 1.0).when(unknown, prob).otherwise(confidence)
    severity = F.when(~attack, "NONE").when(unknown, "CRITICAL").otherwise(severity_by_type(name, confidence, iso))
    return df.withColumns(
        {
            "attack_probability": score(prob),
            "rf_probability": score(rf),
            "xgb_probability": score(xgb),
            "meta_probability": score(prob),
            "iso_score": score(iso),
            "attack_type": attack_type,
            "attack_confidence": F.when(ok, F.round(deciding, 6)).otherwise(0.0),
            "severity": severity,
        }
    )


def early_exit(
    scored: DataFrame, classify: Callable[[DataFrame], DataFrame], class_name: str = "class_name",
    class_confidence: str = "class_confidence",
) -> DataFrame:
    """Run an expensive classifier on known attacks only.

    ``scored`` has ``is_attack`` and ``_unknown``; ``classify`` adds the class columns.  The rows are written
    once and both branches read them, so the models before run once.
    """
    scored = settle(scored, "base-scores")
    known = F.col("is_attack") & ~F.col("_unknown")
    rest = scored.where(~known).withColumns(
        {class_name: F.lit(None).cast("string"), class_confidence: F.lit(None).cast("double")}
    )
    return classify(scored.where(known)).select(*(F.col(f"`{c}`") for c in rest.columns)).unionByName(rest)


def model_info(spark, params: ScoreParams, feature_count: int, medians: int) -> DataFrame:
    """One row describing the loaded parameters."""
    return spark.range(1).select(
        F.lit(feature_count).alias("feature_count"),
        F.lit(params.binary_threshold).alias("binary_threshold"),
        F.lit(params.meta_threshold).alias("meta_threshold"),
        F.lit(params.unknown_iso_threshold).alias("unknown_iso_threshold"),
        F.lit(params.iso_min).alias("iso_min"),
        F.lit(params.iso_max).alias("iso_max"),
        F.lit(medians).alias("feature_medians_n"),
    )
