"""Exact stratified splits and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.clean import q
from netloom.operators.ranks import values_at_ranks
from netloom.operators.sizes import small_table


def stratified_split(
    df: DataFrame,
    label: str = "label",
    fractions: dict[str, float] | None = None,
    seed: int = 42,
    row_id: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split`` with exact per-class shares.

    Rows of a class are ranked by a seeded hash of ``row_id`` (default: the whole row).
    Ranking an 83 % class in one task would not scale; all a row needs is the hash at
    which its class crosses from one split to the next, found through a histogram of
    hashes: one small row per class.  Only copies that share exactly
    that hash are numbered, by content.
    """
    fractions = fractions or {"train": 0.8, "test": 0.2}
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must add up to 1")
    names = list(fractions)
    ident = [q(c) for c in (row_id or df.columns)]
    rows = df.withColumns(
        {
            "_class": F.coalesce(q(label).cast("string"), F.lit("")),
            "_h": F.xxhash64(*ident, F.lit(seed)),
        }
    )
    share, ranks = 0.0, {}
    for name in names[:-1]:
        share += fractions[name]
        ranks[name] = F.round(F.col("total_n") * F.lit(share)).cast("long") - 1  # last rank inside
    crossing = values_at_ranks(
        rows.select("_class", "_h"), ["_class"], "_h", ranks, lambda h: F.shiftright(h, 48), lambda h: F.shiftright(h, 32)
    )
    # One crossing per class and rank, so each value of its row is its own maximum.
    cut = {"h": F.col("_h"), "take": F.col("at") - F.col("before_n") + 1, "n": F.col("n")}
    per_class = small_table(
        crossing.groupBy("_class").agg(
            *(F.max(F.when(F.col("rank") == r, c)).alias(f"_cut_{r}_{k}") for r in ranks for k, c in cut.items())
        )
    )
    rows = rows.join(per_class, "_class", "left")

    at_cut = F.lit(False)
    for name in ranks:
        at, take, n = (F.col(f"_cut_{name}_{k}") for k in ("h", "take", "n"))
        at_cut = at_cut | F.coalesce((F.col("_h") == at) & (take < n), F.lit(False))
    rows = rows.withColumn("_torn", at_cut)
    clear = rows.where(~F.col("_torn")).withColumn("_no", F.lit(0).cast("long"))
    torn = _number_copies(rows.where("_torn"))
    split = F.lit(names[-1])
    for name in reversed(ranks):
        at, take = F.col(f"_cut_{name}_h"), F.col(f"_cut_{name}_take")
        inside = (F.col("_h") < at) | ((F.col("_h") == at) & (F.col("_no") < take))
        split = F.when(inside, name).otherwise(split)
    out = clear.unionByName(torn).withColumn("split", split)
    return out.select(*(q(c) for c in df.columns), "split")


def _number_copies(rows: DataFrame) -> DataFrame:
    """Number the rows of one class and hash from 0.

    Equal rows are counted first (on the map side) and the count is unfolded again, so neither
    the order nor the partitioning of the input matters, and a row that fills a class is one
    row here.  Rows that share the hash without being equal are ordered by their content.
    """
    w = Window.partitionBy("_class", "_h").orderBy("_all").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.groupBy(*(q(c) for c in rows.columns)).agg(F.count("*").alias("_k"))
    plain = [q(c) for c in rows.columns if not c.startswith("_cut_")]
    counted = counted.withColumn("_all", F.xxhash64(*plain, F.lit(1)))
    counted = counted.withColumn("_from", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    step = 100_000
    outer = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1, F.lit(step).cast("long"))).alias("_at")
    parts = counted.select(*(q(c) for c in rows.columns), "_k", "_from", outer)
    inner = F.explode(F.sequence(F.col("_from") + F.col("_at"), F.col("_from") + F.least(F.col("_k"), F.col("_at") + step) - 1))
    return parts.select(*(q(c) for c in rows.columns), inner.alias("_no"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) per class; one row per class."""
    counts = df.groupBy(q(label).alias("label")).agg(F.count("*").alias("rows"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows")))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add each row's balanced weight; the joined side is one row per class."""
    weights = small_table(class_weights(df, label)).select(F.col("label").alias("_label"), F.col("weight").alias(out))
    return df.join(weights, q(label) == F.col("_label"), "left").drop("_label")


def positive_weight(df: DataFrame, y: str = "attack") -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    n = lambda v: F.count(F.when(F.col(y) == v, 1))
    return df.agg(n(0).alias("negatives"), n(1).alias("positives")).withColumn(
        "scale_pos_weight", F.try_divide(F.col("negatives").cast("double"), F.col("positives"))
    )
