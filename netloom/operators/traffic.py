"""Counters over predictions and flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.stages import settle


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def traffic_counters(predictions: DataFrame, window: str | None = None, ts: str = "ts", high: float = 0.85) -> DataFrame:
    """Flow and attack counters, overall or per time window."""
    grouped = predictions.groupBy(F.window(ts, window).alias("w")) if window else predictions.groupBy()
    attack = F.coalesce("is_attack", F.lit(False))
    out = grouped.agg(
        F.count("*").alias("flows"),
        _n(F.col("error").isNull()).alias("predictions"),
        _n(attack).alias("attacks"),
        _n(~attack).alias("benign"),
        _n(attack & (F.col("attack_type") == "UNKNOWN_ATTACK")).alias("unknown_attacks"),
        _n(attack & (F.col("attack_confidence") >= high)).alias("high_confidence_attacks"),
        _n(F.col("iso_score") > 0).alias("anomalies"),
        _n(F.col("error").isNotNull()).alias("errors"),
    )
    out = out.withColumn("attack_rate", F.col("attacks") / F.greatest("predictions", F.lit(1)))
    if window:
        counters = [c for c in out.columns if c != "w"]
        out = out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *counters)
    return out


def attacks_by_type(predictions: DataFrame) -> DataFrame:
    """Predictions per type, benign included, with the attacks among them."""
    attack = F.coalesce("is_attack", F.lit(False))
    return predictions.groupBy("attack_type").agg(F.count("*").alias("predictions"), _n(attack).alias("attacks"))


def top_talkers(flows: DataFrame, col: str = "src_ip", n: int = 10) -> DataFrame:
    """The ``n`` addresses with most flows; ties by address."""
    return flows.groupBy(col).agg(F.count("*").alias("flows")).orderBy(F.desc("flows"), col).limit(n)


def talker_sketch(flows: DataFrame, col: str = "src_ip", tracked: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    """A frequent-items summary of at most ``tracked`` addresses per group; :func:`merged_talkers` joins summaries."""
    return flows.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{col}`, {int(tracked)})").alias("sketch"), F.count(col).alias("flows"))


def merged_talkers(sketches: DataFrame, n: int = 10, tracked: int = 10_000) -> DataFrame:
    """``item, count`` of the most frequent addresses of all summaries: estimates, each off by
    4.7 times the flows over ``tracked`` at most."""
    found = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch"))
    return found.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(n)})")).alias("t")).select("t.item", "t.count")


def frequent_talkers(flows: DataFrame, col: str = "src_ip", n: int = 10, tracked: int = 10_000) -> DataFrame:
    """:func:`top_talkers` without an exchange of all addresses: a summary names candidates, and those are counted exactly.

    An address that the summary lost has 4.7 times the flows over ``tracked`` at most (its error bound), so the result is exact when the ``n``-th
    candidate has more.  Otherwise (no frequent addresses) all are counted.  A null address is none.
    """
    rows = flows.where(F.col(col).isNotNull())
    sketch = settle(talker_sketch(rows, col, tracked), "talkers")
    total = sketch.first().flows
    # At most `tracked` addresses.
    names = merged_talkers(sketch, tracked, tracked).select(F.col("item").alias("of"))
    counted = rows.join(F.broadcast(names), F.col(col) == F.col("of"), "left_semi")
    top = settle(top_talkers(counted, col, n), "top-talkers")
    least = top.agg(F.count("*").alias("n"), F.min("flows").alias("flows")).first()
    sure = least.n == n and least.flows > 4.7 * total / tracked
    return top if sure or total == 0 else top_talkers(rows, col, n)


def protocol_flows(flows: DataFrame) -> DataFrame:
    from netloom.functions.severity import protocol_name

    return flows.groupBy(protocol_name(F.col("protocol")).alias("protocol")).agg(F.count("*").alias("flows"))


def latest_gauges(predictions: DataFrame, ts: str = "ts", rid: str = "flow_id") -> DataFrame:
    """The most recent value of each score gauge."""
    names = ("attack_confidence", "rf_probability", "xgb_probability", "iso_score", "meta_probability", "attack_type")
    newest = F.max_by(F.struct(*names), F.struct(ts, rid)).alias("g")
    return predictions.agg(newest).select("g.*")
