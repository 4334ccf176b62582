"""Thresholds, curves and per-class reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ranks import running_sums, score_bucket


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_counts(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts for ``score >= threshold`` at each distinct score.

    ``y`` is 0/1.  Scores are summed up before anything is ordered, and the running sum
    goes over buckets, so neither ties nor the number of scores end in one task.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    counts = (
        df.select(*by, s.alias("threshold"), F.col(y).cast("int").alias("_y"))
        .where(F.col("threshold").isNotNull() & ~F.isnan("threshold") & F.col("_y").isNotNull())
        .groupBy(*by, "threshold")
        .agg(F.count(F.when(F.col("_y") == 1, 1)).alias("pos"), F.count(F.when(F.col("_y") != 1, 1)).alias("neg"))
    )
    c = running_sums(counts, by, "threshold", ["pos", "neg"], score_bucket(F.col("threshold")))
    return c.select(
        *by,
        "threshold",
        "pos",
        "neg",
        (F.col("total_pos") - F.col("before_pos")).alias("tp"),
        (F.col("total_neg") - F.col("before_neg")).alias("fp"),
        F.col("total_pos").alias("p"),
        F.col("total_neg").alias("n"),
    )


def pr_curve(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    c = score_counts(df, score, y, by)
    tp, fp = F.col("tp"), F.col("fp")
    return c.select(
        *by, "threshold", "tp", "fp", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("p")).alias("recall")
    )


def roc_curve(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    c = score_counts(df, score, y, by)
    return c.select(
        *by, "threshold", _ratio(F.col("fp"), F.col("n")).alias("fpr"), _ratio(F.col("tp"), F.col("p")).alias("tpr")
    )


def f1_of(precision: Column, recall: Column) -> Column:
    """F1 with the small constant that keeps it defined at 0/0."""
    return F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(1e-10))


def best_f1_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of a PR curve with the highest F1; the lowest one on ties."""
    c = curve.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    best = F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold")))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def threshold_grid(df: DataFrame, score: str, y: str, steps: int = 100) -> DataFrame:
    """Precision, recall and F1 at thresholds 1/steps ... (steps-1)/steps.

    One histogram pass: each score falls to the highest grid point not above it.
    """
    s = F.col(score).cast("double")
    cell = F.least(F.greatest(F.floor(s * steps), F.lit(0)), F.lit(steps - 1))
    point = lambda b: b / F.lit(float(steps))
    cell = F.when(s < point(cell), cell - 1).when(s >= point(cell + 1), F.least(cell + 1, F.lit(steps - 1))).otherwise(cell)
    hist = df.where(s.isNotNull() & ~F.isnan(s)).groupBy(cell.alias("cell")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg")
    )
    grid = df.sparkSession.range(-1, steps).select(F.col("id").alias("cell"))  # at most steps + 1 rows
    full = grid.join(hist, "cell", "left").fillna(0)
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell"))
    full = full.withColumns(
        {"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above), "p": F.sum("pos").over(Window.partitionBy(F.lit(0)))}
    ).where(F.col("cell") >= 1)
    tp, fp = F.col("tp"), F.col("fp")
    out = full.select(
        (F.col("cell") / F.lit(float(steps))).alias("threshold"),
        "tp",
        "fp",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, F.col("p")).alias("recall"),
    )
    return out.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def auc_scores(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (trapezoid, ties exact) and ``pr_auc`` (step-wise average precision)."""
    c = score_counts(df, score, y, by)
    pos, neg, tp, fp = (F.col(x).cast("double") for x in ("pos", "neg", "tp", "fp"))
    area = F.sum(neg * (tp * 2 - pos))
    steps = F.sum(pos * tp / (tp + fp))
    return c.groupBy(*by).agg(
        _ratio(area, F.lit(2.0) * F.sum(pos) * F.sum(neg)).alias("roc_auc"), _ratio(steps, F.sum(pos)).alias("pr_auc")
    )


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    return auc_scores(df, score, y).select("roc_auc")


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    return auc_scores(df, score, y).select("pr_auc")


def confusion_matrix(df: DataFrame, y: str, pred: str, classes: Sequence | None = None) -> DataFrame:
    """Counts by (true, predicted) for every pair of classes, zeros included."""
    seen = df.groupBy(F.col(y).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("rows"))
    if classes is None:
        return seen
    names = F.array(*(F.lit(c) for c in classes))
    grid = df.sparkSession.range(1).select(F.explode(names).alias("y_true")).select("y_true", F.explode(names).alias("y_pred"))
    return grid.join(seen, ["y_true", "y_pred"], "left").fillna(0, ["rows"])


def binary_counts(df: DataFrame, y: str, score: str, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    hit, true = F.col(score) >= threshold, F.col(y) == 1

    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return df.groupBy(*by).agg(n(~true & ~hit, "tn"), n(~true & hit, "fp"), n(true & ~hit, "fn"), n(true & hit, "tp"))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR and FNR from tn/fp/fn/tp; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(tp * 2, tp * 2 + fp + fn),
            "fpr": _ratio(fp, fp + tn),
            "fnr": _ratio(fn, fn + tp),
        }
    )


def binary_metrics(df: DataFrame, y: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts, rates and both areas in one row."""
    both = rates(binary_counts(df, y, score, threshold)).withColumn("k", F.lit(0))
    return both.join(auc_scores(df, score, y).withColumn("k", F.lit(0)), "k").drop("k")


def model_comparison(df: DataFrame, y: str, models: dict[str, tuple[str, float]]) -> DataFrame:
    """Metrics of several models side by side; ``models``: name -> (score column, threshold)."""
    rows = [
        F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score"), F.lit(float(t)).alias("threshold"))
        for m, (c, t) in models.items()
    ]
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*rows)).alias("m")).select("y", "m.*")
    counts = rates(binary_counts(long, "y", "score", F.col("threshold"), ["model", "threshold"]))
    return counts.join(auc_scores(long, "score", "y", ["model"]), "model")


def per_class_report(df: DataFrame, y: str, pred: str, rare_below: int = 50) -> DataFrame:
    """Support, precision, recall and F1 of every class, largest support first.

    Built from the confusion counts, which are tiny; the table is read once.
    """
    pairs = confusion_matrix(df, y, pred)
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("y_true").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("long").alias("predicted")),
                F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("rows").alias("predicted")),
            )
        ).alias("s"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("rows")).otherwise(0).alias("hit"),
    )
    # Each correct pair is seen from both sides.
    totals = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("tp")
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(F.col("tp") * 2, F.col("support") + F.col("predicted"))
    return totals.select(
        "class", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("support") < rare_below).alias("rare")
    ).orderBy(F.desc("support"), "class")


def macro_weighted(report: DataFrame) -> DataFrame:
    """Unweighted and support-weighted means over the classes of a report."""
    names = ("precision", "recall", "f1")
    weight = F.col("support")
    return report.agg(
        _ratio(F.sum(F.col("recall") * weight), F.sum(weight)).alias("accuracy"),
        *(F.avg(m).alias(f"macro_{m}") for m in names),
        *(_ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(f"weighted_{m}") for m in names),
    )


def class_counts(df: DataFrame, label: str = "label", benign: str = "BENIGN") -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count("*").alias("test_records"),
        n(F.col(label) != benign).alias("attack_count"),
        n(F.col(label) == benign).alias("benign_count"),
    )
