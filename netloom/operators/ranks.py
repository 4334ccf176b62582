"""Running sums, ranks and exact quantiles without a one-task global window.

A window over a whole column (or over one hot group) would sort it in one task.  Here a
value is mapped to a coarse and a fine bucket, both monotone in the value; sums run over
coarse buckets, then fine buckets inside a coarse one, then values inside a fine one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.stages import settle

_FINE = 65_536
_SPAN = 1_100 * _FINE  # |log2| of a double stays below 1100


def magnitude_bucket(x: Column, fine: int = _FINE) -> Column:
    """Monotone BIGINT bucket of a finite double, ``fine`` buckets per doubling."""
    log = F.greatest(F.least(F.log2(F.abs(x)), F.lit(1_099.0)), F.lit(-1_099.0))
    size = F.floor(log * fine) + 1_100 * fine
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0).cast("long")


def score_bucket(x: Column) -> Column:
    """Like :func:`magnitude_bucket`, but equally fine next to 0 and next to 1."""
    return F.when(x < 0.5, magnitude_bucket(x)).otherwise(4 * _SPAN - magnitude_bucket(1 - x))


def running_sums(
    df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], fine: Column | None
) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``total_<s>`` per ``by`` group.

    ``value`` must be unique within ``by``; aggregate first.  Group columns must not be
    NULL.  The coarse level has at most a few thousand buckets per group.  ``fine=None``
    says that ``value`` is a fine bucket itself.
    """
    by = list(by)
    coarse = F.col("_fine").bitwiseOR(F.lit(_FINE - 1))
    rows = df.withColumn("_fine", F.col(value) if fine is None else fine).withColumn("_coarse", coarse)

    def shifted(part: list[str], order: str, cols: dict[str, str], plus: str | None) -> dict[str, Column]:
        w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(order)
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        out = {}
        for s, c in cols.items():
            inside = F.coalesce(F.sum(c).over(w), F.lit(0))
            out[f"before_{s}"] = inside + F.col(f"{plus}_{s}") if plus else inside
        return out

    if fine is None:
        fine_sums = rows.withColumnsRenamed({s: f"_n_{s}" for s in sums})
    else:
        fine_sums = rows.groupBy(*by, "_coarse", "_fine").agg(*(F.sum(s).alias(f"_n_{s}") for s in sums))
    coarse_sums = fine_sums.groupBy(*by, "_coarse").agg(*(F.sum(f"_n_{s}").alias(f"_n_{s}") for s in sums))
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    n = {s: f"_n_{s}" for s in sums}
    coarse_sums = coarse_sums.select(
        *by,
        "_coarse",
        *(c.alias("_c_" + k[len("before_"):]) for k, c in shifted(by, "_coarse", n, None).items()),
        *(F.sum(f"_n_{s}").over(everything).alias(f"total_{s}") for s in sums),
    )
    fine_sums = fine_sums.join(coarse_sums, [*by, "_coarse"])
    fine_sums = fine_sums.select(
        *by,
        "_fine",
        *(c.alias("_f_" + k[len("before_"):]) for k, c in shifted([*by, "_coarse"], "_fine", n, "_c").items()),
        *(f"total_{s}" for s in sums),
        *(F.col(f"_n_{s}").alias(s) for s in sums if fine is None),
    )
    if fine is None:
        return fine_sums.withColumnsRenamed({"_fine": value, **{f"_f_{s}": f"before_{s}" for s in sums}})
    rows = rows.drop("_coarse").join(fine_sums, [*by, "_fine"])
    rows = rows.withColumns(shifted([*by, "_fine"], value, {s: s for s in sums}, "_f"))
    return rows.drop("_fine", *(f"_f_{s}" for s in sums))


def values_at_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: dict[str, Column],
    bucket: Callable[[Column], Column],
    finer: Callable[[Column], Column],
) -> DataFrame:
    """The values that hold given 0-based ranks, per group.

    ``ranks`` are expressions over ``total_n``; ``bucket`` and ``finer`` are monotone.  Equal
    values are counted before the shuffle, so a value that fills a column is one row from
    there on; a histogram of those counts finds the bucket of each rank, and only the counts of
    these buckets are ranked.  The plan is the same for any number of groups.  The counts, the histogram and the
    buckets found are written (so this runs jobs when called): ``df`` is read once, and the small
    tables that follow have known sizes.  Rows: ``by, rank, at, value, before_n, n, total_n``, where ``at`` is the rank itself.
    """
    by = list(by)
    counted = df.withColumn("_b", bucket(F.col(value))).groupBy(*by, "_b", value).agg(F.count("*").alias("n"))
    counted = settle(counted, "value-counts")
    hist = settle(counted.groupBy(*by, "_b").agg(F.sum("n").alias("n")), "value-histogram")
    hist = running_sums(hist, by, "_b", ["n"], None)
    wanted = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), c.cast("long").alias("at")) for r, c in ranks.items())))
    hist = hist.select(*by, "_b", "n", F.col("before_n").alias("_base"), "total_n", wanted.alias("w"))
    hist = hist.select(*by, "_b", "n", "_base", "total_n", "w.*")
    targets = settle(hist.where((F.col("at") >= F.col("_base")) & (F.col("at") < F.col("_base") + F.col("n"))).drop("n"), "rank-buckets")
    inside = settle(counted.join(targets.select(*by, "_b").distinct(), [*by, "_b"], "left_semi"), "rank-values")
    ranked = running_sums(inside, [*by, "_b"], value, ["n"], finer(F.col(value))).drop("total_n")
    ranked = ranked.join(targets, [*by, "_b"]).withColumn("before_n", F.col("_base") + F.col("before_n"))
    hit = (F.col("at") >= F.col("before_n")) & (F.col("at") < F.col("before_n") + F.col("n"))
    return ranked.where(hit).select(*by, "rank", "at", value, "before_n", "n", "total_n")


def exact_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], quantile: float, *, method: str = "linear"
) -> DataFrame:
    """Exact quantile of each column per group, one row per group.

    NULL is skipped; NaN and infinities must be NULL already.  ``method`` is ``linear``
    (interpolated, so 0.5 is the usual median) or ``index`` (``sorted[int(q * n)]``).
    """
    long = quantile_rows(df, by, cols, [quantile], method=method)
    wide = [F.max(F.when(F.col("c") == i, F.col("q0"))).alias(c) for i, c in enumerate(cols)]
    # A column without any value has no rows above; the group itself must survive.
    groups = long.select(*by, "c", "q0")
    if by:
        groups = groups.unionByName(
            df.select(*by).distinct().withColumns({"c": F.lit(-1), "q0": F.lit(None).cast("double")})
        )
    return groups.groupBy(*by).agg(*wide)


def quantile_rows(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], quantiles: Sequence[float], *, method: str = "linear"
) -> DataFrame:
    """Long form: ``by, c`` (index into ``cols``) and ``q0, q1, ...``, all in one pair of passes."""
    by = list(by)
    pairs = F.explode(
        F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)))
    )
    values = (
        df.select(*by, pairs.alias("p"))
        .select(*by, "p.c", (F.col("p.v") + F.lit(0.0)).alias("v"))
        .where(F.col("v").isNotNull())
    )
    n, ranks, out = F.col("total_n"), {}, {}
    for i, quantile in enumerate(quantiles):
        at = F.lit(quantile) * (n - 1)
        if method == "index":
            ranks[f"lo{i}"] = F.least(F.floor(F.lit(quantile) * n), n - 1)
        else:
            ranks[f"lo{i}"], ranks[f"hi{i}"] = F.floor(at), F.ceil(at)
        lo, hi = (F.max(F.when(F.col("rank") == f"{end}{i}", F.col("v"))) for end in ("lo", "hi"))
        share = F.max(at - F.floor(at))
        out[f"q{i}"] = lo if method == "index" else lo + (hi - lo) * share
    found = values_at_ranks(
        values, [*by, "c"], "v", ranks, magnitude_bucket, lambda x: magnitude_bucket(x, _FINE << 20)
    )
    return found.groupBy(*by, "c").agg(*(c.alias(name) for name, c in out.items()))
