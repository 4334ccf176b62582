"""Training plans: base learners, meta-learner, classifier.

Forests, first-order boosting and logistic regression come from MLlib; boosted trees with second-order gains,
L1/L2 terms and several classes from :mod:`netloom.operators.boosting`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.boosting import BoostedModel, BoostParams, train_boosted
from netloom.operators.clean import q
from netloom.operators.splits import with_class_weight
from netloom.schema import FEATURE_NAMES


def assemble(df: DataFrame, cols: Sequence[str] = FEATURE_NAMES, out: str = "features") -> DataFrame:
    """One feature vector shared by every model."""
    return df.withColumn(out, array_to_vector(F.array(*(q(c).cast("double") for c in cols))))


def probability_of(column: str, klass: int = 1) -> Column:
    return vector_to_array(F.col(column))[klass]


def train_random_forest(df: DataFrame, y: str = "attack", **over) -> "RandomForestClassifier":
    """Forest with balanced class weights; ``df`` has ``features``."""
    params = {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 2, "seed": 42, **over}
    rf = RandomForestClassifier(
        labelCol=y, weightCol="weight", probabilityCol="rf_vec", rawPredictionCol="rf_raw", predictionCol="rf_pred", **params
    )
    return rf.fit(with_class_weight(df, y))


def train_boosted_binary(
    df: DataFrame, y: str = "attack", second_order: dict | None = None, cols: Sequence[str] = FEATURE_NAMES, **over
):
    """Boosted trees with the positive class weighted by negatives / positives.

    ``second_order`` (parameters of :class:`BoostParams`) and ``cols`` choose boosting with L1/L2 terms and column draws.
    """
    n = df.agg(F.count(F.when(F.col(y) == 0, 1)).alias("neg"), F.count(F.when(F.col(y) == 1, 1)).alias("pos")).first()
    weight = F.when(F.col(y) == 1, n.neg / max(n.pos, 1)).otherwise(1.0)
    if second_order is not None:
        return train_boosted(df, cols, y, 2, BoostParams(**{"depth": 8, "l2": 2.0, "l1": 1.0, **second_order}), weight)
    params = {
        "maxIter": 300, "maxDepth": 8, "stepSize": 0.05, "subsamplingRate": 0.8,
        "featureSubsetStrategy": "0.8", "seed": 42, **over,
    }
    weighted = df.withColumn("weight", weight)
    gbt = GBTClassifier(labelCol=y, weightCol="weight", predictionCol="xgb_pred", **params)
    return gbt.setRawPredictionCol("xgb_raw").setProbabilityCol("xgb_vec").fit(weighted)


def train_multiclass(df: DataFrame, y: str = "label_enc", kind: str = "forest", cols: Sequence[str] = FEATURE_NAMES, **over):
    """Classifier over all classes: a forest, one boosted model per class (``ovr``), or softmax boosting (``softmax``)."""
    weighted = with_class_weight(df.withColumn(y, F.col(y).cast("double")), y)
    if kind == "forest":
        params = {"numTrees": 300, "maxDepth": 6, "seed": 42, **over}
        return RandomForestClassifier(
            labelCol=y, weightCol="weight", probabilityCol="class_vec", rawPredictionCol="class_raw",
            predictionCol="class_pred", **params,
        ).fit(weighted)
    if kind == "softmax":
        classes = int(weighted.agg(F.max(y)).first()[0]) + 1
        return train_boosted(weighted, cols, y, classes, BoostParams(**over), F.col("weight"))
    if kind != "ovr":
        raise ValueError("kind must be 'forest', 'ovr' or 'softmax'")
    params = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42, **over}
    return OneVsRest(
        # One-vs-rest reads its models' margins under its own name for them.
        classifier=GBTClassifier(**params).setRawPredictionCol("class_raw"), labelCol=y, weightCol="weight", predictionCol="class_pred",
        rawPredictionCol="class_raw",
    ).fit(weighted)


def train_meta_learner(df: DataFrame, y: str = "attack", scores: Sequence[str] = ("rf", "xgb", "iso"), c: float = 1.0):
    """Logistic regression on base scores; L2 strength equal to an inverse weight ``c``.

    Fit it on the validation split: on the test split it would judge itself.
    """
    df = VectorAssembler(inputCols=list(scores), outputCol="meta_in").transform(df)
    n = df.count()
    lr = LogisticRegression(
        featuresCol="meta_in", labelCol=y, probabilityCol="meta_vec", rawPredictionCol="meta_raw",
        predictionCol="meta_pred", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000,
    )
    return lr.fit(df)


def with_base_scores(df: DataFrame, forest, boosted) -> DataFrame:
    """Add ``rf`` and ``xgb`` attack probabilities in one pass."""
    scored = forest.transform(df)
    scored = boosted.transform(scored, "xgb_vec", "xgb_pred") if isinstance(boosted, BoostedModel) else boosted.transform(scored)
    keep = [c for c in df.columns]
    xgb = F.get("xgb_vec", F.lit(1)) if isinstance(boosted, BoostedModel) else probability_of("xgb_vec")
    return scored.select(*(q(c) for c in keep), probability_of("rf_vec").alias("rf"), xgb.alias("xgb"))


def with_class(df: DataFrame, model, class_names: Sequence[str]) -> DataFrame:
    """Add ``class_name`` and ``class_confidence``.

    One-vs-rest models have margins only: each becomes the probability of its binary model, scaled to the sum 1.
    """
    names = F.array(*(F.lit(c) for c in class_names))
    if isinstance(model, BoostedModel):
        scored, probs = model.transform(df, "class_vec", "class_pred"), F.col("class_vec")
    else:
        scored = model.transform(df)
        if "class_vec" in scored.columns:
            probs = vector_to_array("class_vec")
        else:
            each = F.transform(vector_to_array("class_raw"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
            scored = scored.withColumn("_each", each)
            total = F.aggregate("_each", F.lit(0.0), lambda a, b: a + b)
            probs = F.transform("_each", lambda v: v / total)
    best = F.array_max(probs)
    return scored.select(
        *(q(c) for c in df.columns),
        F.get(names, (F.array_position(probs, best) - 1).cast("int")).alias("class_name"),
        best.alias("class_confidence"),
    )


def feature_importance(spark, models: dict[str, object], cols: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Rows ``(feature, <model>_importance ...)``, one per feature."""
    importances = {m: model.featureImportances.toArray().tolist() for m, model in models.items()}
    rows = [(c, *(float(v[i]) for v in importances.values())) for i, c in enumerate(cols)]
    schema = "feature string, " + ", ".join(f"`{m}_importance` double" for m in models)
    return spark.createDataFrame(rows, schema)


def top_features(importance: DataFrame, by: str, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc(by), "feature").limit(n)


__all__ = [
    "PipelineModel", "assemble", "feature_importance", "probability_of", "top_features", "train_boosted_binary",
    "train_meta_learner", "train_multiclass", "train_random_forest", "with_base_scores", "with_class",
]
