"""Data-quality reports over labelled flow tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.clean import clean_label, numeric_columns, q
from netloom.operators.ranks import quantile_rows


def _is_missing(field: T.StructField) -> Column:
    c = q(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return c.isNull()


def _missing_cells(df: DataFrame, skip: Iterable[str] = ()) -> Column:
    skip = set(skip)
    return sum((_is_missing(f).cast("long") for f in df.schema if f.name not in skip), F.lit(0).cast("long"))


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def profile(
    df: DataFrame, label: str = "label", benign: str = "BENIGN", row_no: str | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """One row: size, missing cells, duplicate rows, class balance.

    Rows are grouped once with their count, so duplicates need no second pass.  Without
    ``chunk_rows`` duplicates are counted over the whole table; with it, inside chunks of
    consecutive ``row_no``.  Missing values compare as equal to each other.
    """
    data = [c for c in df.columns if c != row_no]
    fields = {f.name: f for f in df.schema}
    as_null = [F.when(~_is_missing(fields[c]), q(c)).alias(c) for c in data]
    group = []
    if chunk_rows is not None:
        if row_no is None:
            raise ValueError("chunked duplicates need an explicit row number column")
        group = [F.floor(F.col(row_no) / chunk_rows).alias("_chunk")]
    rows = df.select(*as_null, *group)
    rows = rows.withColumn("_missing", sum((q(c).isNull().cast("long") for c in data), F.lit(0).cast("long")))
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    is_benign = clean_label(q(label)) == benign
    n, width = F.sum("_n"), len(data)
    r = distinct.agg(
        n.alias("rows"),
        F.lit(width).cast("long").alias("columns"),
        F.sum(F.col("_missing") * F.col("_n")).alias("missing_cells"),
        (n - F.count("*")).alias("duplicate_rows"),
        F.sum(F.when(is_benign, F.col("_n")).otherwise(0)).alias("benign"),
    )
    r = r.withColumn("attack", F.col("rows") - F.col("benign"))
    return r.select(
        "rows",
        "columns",
        "missing_cells",
        _percent(F.col("missing_cells"), F.col("rows") * width).alias("missing_pct"),
        "duplicate_rows",
        _percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
        "benign",
        _percent(F.col("benign"), F.col("rows")).alias("benign_pct"),
        "attack",
        _percent(F.col("attack"), F.col("rows")).alias("attack_pct"),
        F.try_divide(F.col("benign").cast("double"), F.col("attack")).alias("imbalance_ratio"),
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share per cleaned label, most frequent first."""
    counts = df.groupBy(clean_label(q(label)).alias("label")).agg(F.count("*").alias("rows"))
    share = _percent(F.col("rows"), F.sum("rows").over(Window.partitionBy(F.lit(0))))
    return counts.withColumn("pct", share).orderBy(F.desc("rows"), "label")


def label_loss_report(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Per label: rows before and after cleaning, rows lost, percentage lost."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(clean_label(q(label)).alias("label")).agg(F.count("*").alias(name))

    both = counts(before, "b").join(counts(after, "a"), "label", "full_outer")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    return both.select(
        "label",
        b.alias("before"),
        a.alias("after"),
        (b - a).alias("lost"),
        F.when(b > 0, (b - a) * F.lit(100.0) / b).otherwise(0.0).alias("lost_pct"),
    )


def missing_report(df: DataFrame, by: str = "source_file") -> DataFrame:
    """Missing cells per file, as a count and as a share of the file's cells."""
    width = len(df.columns) - 1
    out = df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(_missing_cells(df, [by])).alias("missing_cells"))
    return out.withColumn("missing_pct", _percent(F.col("missing_cells"), F.col("rows") * width))


@dataclass(frozen=True)
class Expectations:
    """What a cleaned table should look like; the defaults are those of the full dataset."""

    min_rows: int = 2_500_000
    max_rows: int = 2_830_743
    labels: int = 15
    ratio: tuple[float, float] = (3.5, 5.0)
    rare: tuple[str, ...] = ("Heartbleed", "Web Attack - Sql Injection", "Infiltration")
    benign: str = "BENIGN"


def quality_gate(df: DataFrame, expect: Expectations = Expectations(), label: str = "label") -> DataFrame:
    """Rows ``(no, check, value, status)``; only NaN and Inf checks can FAIL the verdict."""
    fields = {f.name: f for f in df.schema}
    floats = [n for n, f in fields.items() if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    zero = F.lit(0).cast("long")
    inf = sum((F.coalesce(F.abs(q(c)) == F.lit(float("inf")), F.lit(False)).cast("long") for c in floats), zero)
    nan = sum((q(c).isNull().cast("long") for c in fields if c not in floats), zero)
    nan = sum(((q(c).isNull() | F.isnan(q(c))).cast("long") for c in floats), nan)
    rows = df.select("*", nan.alias("_nan"), inf.alias("_inf"))
    distinct = rows.groupBy(*(q(c) for c in rows.columns)).agg(F.count("*").alias("_n"))
    n = F.sum("_n")
    # Two steps: label counts are needed both as a distinct count and per class.
    per_label = distinct.groupBy(q(label).alias("_label")).agg(
        n.alias("_rows"),
        F.count("*").alias("_distinct"),
        F.sum(F.col("_nan") * F.col("_n")).alias("_nan"),
        F.sum(F.col("_inf") * F.col("_n")).alias("_inf"),
    )
    benign = F.sum(F.when(F.col("_label") == expect.benign, F.col("_rows")).otherwise(0))
    m = per_label.agg(
        F.sum("_rows").alias("rows"),
        (F.sum("_rows") - F.sum("_distinct")).alias("dup"),
        F.sum("_nan").alias("nan"),
        F.sum("_inf").alias("inf"),
        F.count("_label").alias("labels"),
        benign.alias("benign"),
        *(
            F.sum(F.when(F.col("_label") == c, F.col("_rows")).otherwise(0)).alias(f"rare{i}")
            for i, c in enumerate(expect.rare)
        ),
    )
    c = F.col
    dup_pct = _percent(c("dup"), c("rows"))
    attack = c("rows") - c("benign")
    ratio = F.try_divide(c("benign").cast("double"), attack)
    lost = sum((F.when(c(f"rare{i}") == 0, 1).otherwise(0) for i in range(len(expect.rare))), F.lit(0))
    lo, hi = expect.ratio

    def status(ok: Column, bad: str) -> Column:
        return F.when(ok, "PASS").otherwise(bad)

    dup_status = F.when(dup_pct < 0.5, "PASS").when(dup_pct < 2.0, "INFO").otherwise("WARN")
    checks = [
        ("rows", c("rows"), status(c("rows").between(expect.min_rows, expect.max_rows), "WARN")),
        ("nan", c("nan"), status(c("nan") == 0, "FAIL")),
        ("inf", c("inf"), status(c("inf") == 0, "FAIL")),
        ("duplicate_pct", dup_pct, dup_status),
        ("labels", c("labels"), status(c("labels") == expect.labels, "WARN")),
        ("benign_rows", c("benign"), F.lit("INFO")),
        ("imbalance_ratio", ratio, F.coalesce(status(ratio.between(lo, hi), "WARN"), F.lit("WARN"))),
        ("rare_classes_lost", lost, status(lost == 0, "WARN")),
        ("verdict", c("nan") + c("inf"), status((c("nan") == 0) & (c("inf") == 0), "FAIL")),
    ]
    table = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i + 1).alias("no"),
                    F.lit(name).alias("check"),
                    value.cast("double").alias("value"),
                    state.alias("status"),
                )
                for i, (name, value, state) in enumerate(checks)
            )
        )
    )
    return m.select(table.alias("r")).select("r.*")


def rare_classes(df: DataFrame, n: int = 50, label: str = "label") -> DataFrame:
    """Labels with fewer than ``n`` rows."""
    return df.groupBy(q(label).alias("label")).agg(F.count("*").alias("rows")).where(F.col("rows") < n)


def feature_summary(df: DataFrame, cols: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Long table: count, mean, sample deviation, min, max and exact quantiles per feature."""
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        for stat, fn in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            aggs.append(fn(x).alias(f"{stat}_{i}"))
    stats = ("count", "mean", "std", "min", "max")

    def long(wide: DataFrame, names: tuple[str, ...], pick) -> DataFrame:
        rows = [
            F.struct(F.lit(c).alias("feature"), *(pick(i, c, s).alias(s) for s in names)) for i, c in enumerate(cols)
        ]
        return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    out = long(df.agg(*aggs), stats, lambda i, c, s: F.col(f"{s}_{i}"))
    names = F.array(*(F.lit(c) for c in cols))
    part = quantile_rows(df, [], cols, quantiles).select(
        F.get(names, F.col("c")).alias("feature"), *(F.col(f"q{i}").alias(f"p{round(p * 100)}") for i, p in enumerate(quantiles))
    )
    out = out.join(part, "feature", "left")
    return out
