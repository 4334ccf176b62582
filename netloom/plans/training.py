"""The offline plan: labelled rows to fitted models, scores and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.config import ScoreParams
from netloom.operators import clean, models
from netloom.operators.boosting import BoostedModel
from netloom.operators.isolation import IsolationForest, IsolationForestModel
from netloom.operators.scoring import early_exit, fit_anomaly_range, input_error, normalise_anomaly, with_verdict
from netloom.operators.splits import stratified_split
from netloom.operators.stages import settle


@dataclass(frozen=True)
class TrainingParams:
    """Model sizes; the defaults are those of the full dataset."""

    fractions: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "val": 0.1, "test": 0.2})
    forest: dict = field(default_factory=dict)
    boosted: dict = field(default_factory=dict)
    classes: dict = field(default_factory=dict)
    isolation: dict = field(default_factory=dict)
    fit_split: str = "val"
    benign: str = "BENIGN"


@dataclass
class FittedStack:
    """Everything needed to score rows that carry the feature columns."""

    cols: list[str]
    medians: dict[str, float]
    scale: dict[str, tuple[float, float]]
    forest: object
    boosted: object
    isolation: object
    meta: object
    classes: object
    class_names: list[str]
    params: ScoreParams

    def base_scores(self, df: DataFrame) -> DataFrame:
        """Impute, then add ``features``, ``rf``, ``xgb`` and ``iso``."""
        df = df.withColumn("error", input_error(df, [])) if "error" not in df.columns else df
        filled = clean.impute_at_inference(df, self.medians, self.cols)
        rows = models.with_base_scores(models.assemble(filled, self.cols), self.forest, self.boosted)
        scaled = F.array(*((clean.q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scale.items()))
        rows = self.isolation.transform(rows.withColumn("scaled", scaled)).drop("scaled")
        return rows.withColumn("iso", normalise_anomaly(F.col("iso_decision"), self.params)).drop("iso_decision")

    def judged(self, df: DataFrame) -> DataFrame:
        """Base scores, ``meta``, ``is_attack`` and the class; only known attacks reach the class model."""
        rows = models.VectorAssembler(inputCols=["rf", "xgb", "iso"], outputCol="meta_in").transform(self.base_scores(df))
        rows = self.meta.transform(rows).withColumn("meta", models.probability_of("meta_vec"))
        rows = rows.drop("meta_in", "meta_vec", "meta_raw", "meta_pred")
        rows = rows.withColumn("is_attack", F.col("meta") >= self.params.meta_threshold)
        rows = rows.withColumn("_unknown", F.col("is_attack") & (F.col("iso") >= self.params.unknown_iso_threshold))
        return early_exit(rows, lambda known: models.with_class(known, self.classes, self.class_names))

    def flow_scores(self, df: DataFrame) -> DataFrame:
        """The scores a detection plan needs: ``rf, xgb, iso, meta, class_name, class_confidence``."""
        return self.judged(df).drop("is_attack", "_unknown", "features", "error")

    def score(self, df: DataFrame) -> DataFrame:
        """Predictions; the class model runs on known attacks only."""
        scores = [F.col(c) for c in ("rf", "xgb", "iso", "meta", "class_name", "class_confidence")]
        return with_verdict(self.judged(df), *scores).drop("meta", "_unknown", "features")

    def save(self, spark: SparkSession, path: str) -> None:
        """Model folders, the isolation forest's table and a one-row table of parameters."""
        named = {"forest": self.forest, "boosted": self.boosted, "classes": self.classes, "meta": self.meta}
        tables = [n for n, m in named.items() if isinstance(m, BoostedModel)]
        for name in tables:
            named[name].save_table(spark, f"{path}/{name}")
        stages = [m for n, m in named.items() if n not in tables]
        models.PipelineModel(stages).write().overwrite().save(f"{path}/models")
        self.isolation.save_table(spark, f"{path}/isolation")
        plain = {"cols": self.cols, "medians": self.medians, "scale": self.scale, "class_names": self.class_names, "params": asdict(self.params), "tables": tables}
        spark.createDataFrame([(json.dumps(plain),)], "parameters string").write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedStack":
        stages = iter(models.PipelineModel.load(f"{path}/models").stages)
        isolation = IsolationForestModel.load_table(spark, f"{path}/isolation")
        raw = json.loads(spark.read.parquet(f"{path}/parameters").first().parameters)
        scale = {c: (m, s) for c, (m, s) in raw["scale"].items()}
        names = ("forest", "boosted", "classes", "meta")
        forest, boosted, classes, meta = (
            BoostedModel.load_table(spark, f"{path}/{n}") if n in raw.get("tables", ()) else next(stages) for n in names
        )
        return cls(raw["cols"], raw["medians"], scale, forest, boosted, isolation, meta, classes, raw["class_names"], ScoreParams(**raw["params"]))


def train(df: DataFrame, cols: Sequence[str], label: str = "label", params: TrainingParams = TrainingParams()) -> tuple[FittedStack, DataFrame]:
    """Fit the whole stack on cleaned rows; returns it with the split table.

    The split table is written once, since every model reads it again.
    """
    cols = list(cols)
    df = clean.normalise_missing(clean.clean_labels(df, label))
    medians = clean.global_medians(df, cols).first().asDict()
    medians = {c: m for c, m in medians.items() if m is not None}
    parts = stratified_split(df, label, params.fractions)
    parts = clean.binary_label(parts, label, "attack", params.benign)
    parts = settle(models.assemble(clean.impute_at_inference(parts, medians, cols), cols), "splits")
    fit_rows = parts.where("split = 'train'")

    forest = models.train_random_forest(fit_rows, **params.forest)
    boosted = models.train_boosted_binary(fit_rows, cols=cols, **params.boosted)
    benign = fit_rows.where("attack = 0")
    scale = clean.fit_standardiser(benign, cols)
    scaled = F.array(*((clean.q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()))
    isolation = IsolationForest(**params.isolation).fit(benign.withColumn("scaled", scaled))

    held = parts.where(F.col("split") == params.fit_split)
    lo, hi = fit_anomaly_range(isolation.transform(held.withColumn("scaled", scaled)))
    scores = ScoreParams(iso_min=lo, iso_max=hi)
    # The class model learns all classes; only attacks reach it when scoring.
    indexer = StringIndexer(inputCol=label, outputCol="label_enc", stringOrderType="alphabetAsc").fit(fit_rows)
    classes = models.train_multiclass(indexer.transform(fit_rows), cols=cols, **params.classes)
    stack = FittedStack(cols, medians, scale, forest, boosted, isolation, None, classes, list(indexer.labels), scores)
    stack.meta = models.train_meta_learner(stack.base_scores(held.drop("features")))
    return stack, parts
