"""Latency histograms, counter rates and time-window rules over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ranks import quantile_rows
from netloom.schema import INFERENCE_BUCKETS_MS

_HOUR_US = 3_600_000_000


def latency_histogram(
    df: DataFrame, col: str = "latency_ms", buckets: Sequence[float] = INFERENCE_BUCKETS_MS, by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``(le, cum_count, sum, count)`` per group; the last bucket is unbounded.

    One pass with one conditional count per bucket, then a fixed fan-out.
    """
    bounds = [*map(float, buckets), float("inf")]
    x = F.col(col)
    wide = df.groupBy(*by).agg(
        *(F.count(F.when(x <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds[:-1])),
        F.count(x).alias("count"),
        F.sum(x).alias("sum"),
    )
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum_count")) for i, b in enumerate(bounds[:-1])]
    cells.append(F.struct(F.lit(bounds[-1]).alias("le"), F.col("count").alias("cum_count")))
    return wide.select(*by, F.explode(F.array(*cells)).alias("c"), "sum", "count").select(
        *by, "c.le", "c.cum_count", "sum", "count"
    )


def histogram_quantile(hist: DataFrame, quantile: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile of a bucket table, linear inside the bucket that holds it.

    In the unbounded bucket it is the highest finite bound; without samples it is NULL.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("le")
    total = F.max("cum_count").over(Window.partitionBy(*(by or [F.lit(0)])))
    rows = hist.select(
        *by,
        "le",
        F.col("cum_count").cast("double").alias("cum"),
        F.lag("le", 1, 0.0).over(w).alias("lower"),
        F.lag(F.col("cum_count").cast("double"), 1, 0.0).over(w).alias("below"),
        total.alias("total"),
    ).withColumn("rank", F.lit(quantile) * F.col("total"))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * F.try_divide(
        F.col("rank") - F.col("below"), F.col("cum") - F.col("below")
    )
    value = F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside)
    hit = (F.col("cum") >= F.col("rank")) & (F.col("total") > 0)
    # The first bucket reaching the rank holds the quantile.
    first = F.min_by(F.when(hit, value), F.when(hit, F.col("le")))
    return rows.groupBy(*by).agg(first.alias("value"))


def latency_summary(
    df: DataFrame, col: str = "latency_ms", by: Sequence[str] = (), percents: Sequence[int] = (50, 95, 99)
) -> DataFrame:
    """Average, min, max, nearest-rank percentiles ``sorted[int(q * n)]`` and rate per second.

    Percentiles are exact and counted, not collected.
    """
    out = df.groupBy(*by).agg(
        F.count(col).alias("samples"), F.avg(col).alias("avg_ms"), F.min(col).alias("min_ms"), F.max(col).alias("max_ms")
    )
    key = list(by) or ["_k"]
    if not by:
        out = out.withColumn("_k", F.lit(0))
    part = quantile_rows(df, by, [col], [p / 100 for p in percents], method="index").drop("c")
    part = part.withColumnsRenamed({f"q{i}": f"p{p}_ms" for i, p in enumerate(percents)})
    out = out.join(part if by else part.withColumn("_k", F.lit(0)), key, "left")
    out = out.withColumn("throughput_per_s", F.try_divide(F.lit(1000.0), F.col("avg_ms")))
    return out if by else out.drop("_k")


def latency_sketches(
    df: DataFrame, col: str = "latency_ms", window: str = "1 hour", ts: str = "ts", by: Sequence[str] = (), k: int = 400
) -> DataFrame:
    """A quantile sketch per window and group, to be kept and merged: ``window_start, samples, sketch``.

    This is the approximate mode beside :func:`latency_summary`; ``k`` sets the error (see :func:`rank_error`).
    """
    out = df.where(F.col(col).isNotNull()).groupBy(*by, F.window(ts, window).alias("w")).agg(
        F.count("*").alias("samples"), F.expr(f"kll_sketch_agg_double(CAST(`{col}` AS DOUBLE), {int(k)})").alias("sketch")
    )
    return out.select(*by, F.col("w.start").alias("window_start"), "samples", "sketch")


def rank_error(k: int = 400) -> float:
    """How far an estimate's rank may be off, as a share of the samples (with 99 % confidence)."""
    return 2.446 / k**0.9433


def merged_latency(sketches: DataFrame, by: Sequence[str] = (), percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Percentiles over any set of windows, from their sketches alone."""
    out = sketches.groupBy(*by).agg(F.sum("samples").alias("samples"), F.expr("kll_merge_agg_double(sketch)").alias("_s"))
    return out.select(*by, "samples", *(F.expr(f"kll_sketch_get_quantile_double(_s, {p / 100})").alias(f"p{p}_ms") for p in percents))


def weighted_latency(summary: DataFrame, path: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Overall average over the paths of a summary (default: 83.5 % benign, 16.5 % attack)."""
    weights = weights or {"benign": 0.835, "attack": 0.165}
    share = F.lit(0.0)
    for name, weight in weights.items():
        share = share + F.sum(F.when(F.col(path) == name, F.col("avg_ms") * weight).otherwise(0.0))
    return summary.agg(share.alias("avg_ms")).withColumn("throughput_per_s", F.try_divide(F.lit(1000.0), F.col("avg_ms")))


# -- rates ---------------------------------------------------------------------------------


def counter_rate(samples: DataFrame, series: Sequence[str] = ("name",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Rate between neighbouring samples of each counter, never negative, over at least 1 ms.

    A long series is cut into hours; the last sample of the hour before is carried over,
    so that one busy series is not one task.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = samples.withColumns({"_us": us, "_hour": F.floor(us / _HOUR_US)})
    w = Window.partitionBy(*series, "_hour").orderBy("_us")
    here = F.struct(F.col("_us").alias("us"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({"_here": here, "_prev": F.lag(here).over(w)})
    ends = rows.groupBy(*series, "_hour").agg(F.max("_here").alias("_end"))
    across = Window.partitionBy(*series).orderBy("_hour")
    ends = ends.withColumn("_before", F.lag("_end").over(across)).drop("_end")
    rows = rows.join(ends, [*series, "_hour"]).withColumn("_p", F.coalesce("_prev", "_before"))
    seconds = F.greatest((F.col("_us") - F.col("_p.us")) / F.lit(1e6), F.lit(0.001))
    rate = F.greatest((F.col(value) - F.col("_p.v")) / seconds, F.lit(0.0))
    return rows.where(F.col("_p").isNotNull()).select(*series, ts, value, rate.alias("rate"))


def per_second(events: DataFrame, every: str = "5 seconds", ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Events per second in tumbling windows (packets or flows)."""
    out = events.groupBy(*by, F.window(ts, every).alias("w")).agg(F.count("*").alias("events"))
    length = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select(*by, F.col("w.start").alias("window_start"), "events", (F.col("events") / length).alias("per_second"))


def increase(
    events: DataFrame, window: str = "1 minute", slide: str = "5 seconds", where: str | Column = "true",
    ts: str = "ts", by: Sequence[str] = (),
) -> DataFrame:
    """Matching events in the window that ends at each evaluation time.

    Events are first counted per slide step; only the steps fan out into windows.
    """
    steps = events.where(where).groupBy(*by, F.window(ts, slide).alias("s")).agg(F.count("*").alias("n"))
    steps = steps.select(*by, F.col("s.start").alias("at"), "n")
    out = steps.groupBy(*by, F.window("at", window, slide).alias("w")).agg(F.sum("n").alias("increase"))
    return out.select(*by, F.col("w.end").alias("ts"), "increase")


def firing(series: DataFrame, value: str, threshold: float, ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Evaluation rows with a boolean ``cond``: value above the threshold."""
    return series.select(*by, ts, value, (F.col(value) > threshold).alias("cond"))


def hold_for(
    evaluations: DataFrame, seconds: float, cond: str = "cond", ts: str = "ts", by: Sequence[str] = (),
    step_s: float | None = None,
) -> DataFrame:
    """Intervals in which a condition stayed true for at least ``seconds``.

    With ``step_s`` a missing evaluation (a step without events) ends the interval.
    Returns ``started, fired, ended`` per interval: first true evaluation, when the hold
    time was reached, last true evaluation.  Evaluations are few (one per step), yet they
    are scanned per day and joined at midnight only by their first and last row.
    """
    key = list(by)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = evaluations.select(*key, us.alias("us"), F.coalesce(cond, F.lit(False)).alias("c"))
    rows = rows.withColumn("_day", F.floor(F.col("us") / (24 * _HOUR_US)))
    w = Window.partitionBy(*key, "_day").orderBy("us")
    rows = rows.withColumns({"_pu": F.lag("us").over(w), "_pc": F.lag("c").over(w)})
    gap = round(step_s * 1_000_000) if step_s else None
    near = (F.col("us") - F.col("_pu") <= gap) if gap else F.lit(True)
    rows = rows.withColumn("_cut", ~F.coalesce(F.col("_pc") & near, F.lit(False)))
    rows = rows.withColumn("_run", F.count(F.when(F.col("_cut"), 1)).over(w))
    islands = rows.where("c").groupBy(*key, "_day", "_run").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    # Islands that touch across midnight are one.
    edges = evaluations.select(*key, us.alias("us")).withColumn("_day", F.floor(F.col("us") / (24 * _HOUR_US)))
    edges = edges.groupBy(*key, "_day").agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    across = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_day")
    edges = edges.withColumn("_before", F.lag("_last").over(across))
    islands = islands.join(edges, [*key, "_day"])
    order = Window.partitionBy(*(key or [F.lit(0)])).orderBy("a")
    touches = (F.col("a") == F.col("_first")) & (F.lag("b").over(order) == F.col("_before"))
    if gap:
        touches = touches & (F.col("a") - F.col("_before") <= gap)
    islands = islands.withColumn("_new", ~F.coalesce(touches, F.lit(False)))
    islands = islands.withColumn("_id", F.count(F.when(F.col("_new"), 1)).over(order))
    merged = islands.groupBy(*key, "_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    hold = round(seconds * 1_000_000)
    return merged.where(F.col("b") - F.col("a") >= hold).select(
        *key,
        F.timestamp_micros("a").alias("started"),
        F.timestamp_micros(F.col("a") + hold).alias("fired"),
        F.timestamp_micros("b").alias("ended"),
    )


def windowed_ratio(events: DataFrame, part: str | Column, window: str, ts: str = "ts") -> DataFrame:
    """Share of matching events per tumbling window, denominator floored at 1."""
    hit = F.expr(part) if isinstance(part, str) else part
    out = events.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.when(hit, 1)).alias("hits"), F.count("*").alias("events")
    )
    return out.select(F.col("w.start").alias("ts"), "hits", "events", (F.col("hits") / F.greatest("events", F.lit(1))).alias("ratio"))


def windowed_average(events: DataFrame, value: str, window: str, ts: str = "ts") -> DataFrame:
    """Sum / count per tumbling window."""
    out = events.groupBy(F.window(ts, window).alias("w")).agg(F.sum(value).alias("sum"), F.count(value).alias("count"))
    return out.select(F.col("w.start").alias("ts"), "sum", "count", F.try_divide("sum", "count").alias("average"))


def absence(
    heartbeats: DataFrame, seconds: float = 15.0, source: Sequence[str] = ("source",), ts: str = "ts", now: str | None = None
) -> DataFrame:
    """Periods in which a source was silent for more than ``seconds``.

    With ``now`` (a timestamp literal) silence after the last heartbeat counts too.
    A longer silence never lies inside a bucket of ``seconds``, so the first and last
    heartbeat per bucket are enough; heartbeats themselves are not sorted.
    """
    limit = round(seconds * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = heartbeats.select(*source, us.alias("us")).withColumn("_bucket", F.floor(F.col("us") / limit))
    ends = rows.groupBy(*source, "_bucket").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    across = Window.partitionBy(*source).orderBy("_bucket")
    gaps = ends.select(*source, F.lag("last").over(across).alias("from_us"), F.col("first").alias("us"))
    gaps = gaps.where(F.col("from_us").isNotNull())
    if now is not None:
        clock = F.unix_micros(F.lit(now).cast("timestamp"))
        final = ends.groupBy(*source).agg(F.max("last").alias("from_us"))
        gaps = gaps.unionByName(final.select(*source, "from_us", clock.alias("us")))
    return gaps.where(F.col("us") - F.col("from_us") > limit).select(
        *source,
        F.timestamp_micros("from_us").alias("silent_from"),
        F.timestamp_micros(F.col("from_us") + limit).alias("fired"),
        F.timestamp_micros("us").alias("silent_until"),
    )
