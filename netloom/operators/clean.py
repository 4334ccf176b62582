"""Cleaning labelled flow tables: missing values, labels, imputation, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.ranks import exact_quantiles
from netloom.operators.sizes import small_table
from netloom.schema import FEATURE_NAMES


def q(name: str) -> Column:
    """Column by exact name; feature names contain dots and slashes."""
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def normalise_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL in every fractional column (or in ``cols``)."""
    fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    cols = fractional if cols is None else fractional.intersection(cols)
    return df.select(*(finite_or_null(q(c)).alias(c) if c in cols else q(c) for c in df.columns))


def clean_label(label: Column) -> Column:
    """Trim, and turn the replacement character of a bad decode into a dash."""
    return F.replace(F.trim(label), F.lit("�"), F.lit("-"))


def clean_labels(df: DataFrame, col: str = "label") -> DataFrame:
    return df.withColumn(col, clean_label(q(col)))


def binary_label(df: DataFrame, col: str = "label", out: str = "attack", benign: str = "BENIGN") -> DataFrame:
    """0 for the benign label (case and surrounding space ignored), else 1."""
    return df.withColumn(out, F.when(F.upper(F.trim(q(col))) == benign, 0).otherwise(1))


def encode_labels(df: DataFrame, col: str = "label", out: str = "label_enc") -> tuple[DataFrame, StringIndexerModel]:
    """Classes numbered in lexicographic order; the model holds only the class names."""
    model = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int")), model


def decode_labels(df: DataFrame, labels: Sequence[str], col: str = "label_enc", out: str = "label") -> DataFrame:
    df = df.withColumn(col, F.col(col).cast("double"))
    decoded = IndexToString(inputCol=col, outputCol=out, labels=list(labels)).transform(df)
    return decoded.withColumn(col, F.col(col).cast("int"))


def downcast(df: DataFrame) -> DataFrame:
    """64-bit numbers to 32-bit ones, for storage, where every value fits.

    One aggregation finds the range of each column; a column with a value beyond it stays.
    """
    limits = {T.DoubleType(): ("float", 3.4028234663852886e38), T.LongType(): ("int", 2**31 - 1)}
    wide = [f for f in df.schema if f.dataType in limits]
    if not wide:
        return df

    def fits(f: T.StructField) -> Column:
        at_most = F.abs(q(f.name).cast("double")) <= float(limits[f.dataType][1])
        if isinstance(f.dataType, T.DoubleType):
            at_most |= F.isnan(q(f.name)) | (F.abs(q(f.name)) == float("inf"))
        return F.coalesce(F.bool_and(at_most), F.lit(True))

    found = df.agg(*(fits(f).alias(str(i)) for i, f in enumerate(wide))).first()
    narrow = {f.name: limits[f.dataType][0] for i, f in enumerate(wide) if found[i]}
    return df.select(*(q(c).cast(narrow[c]).alias(c) if c in narrow else q(c) for c in df.columns))


def fit_medians(df: DataFrame, cols: Sequence[str], by: str | None = "source_file", exact: bool = True) -> DataFrame:
    """Median of each column per ``by`` group (one row overall when ``by`` is None).

    Run :func:`normalise_missing` first: NULL is skipped, NaN would be a value.
    """
    group = [by] if by else []
    if exact:
        return exact_quantiles(df, group, cols, 0.5)
    return df.groupBy(*group).agg(*(F.percentile_approx(q(c), 0.5, 100_000).alias(c) for c in cols))


def impute_median(df: DataFrame, medians: DataFrame, cols: Sequence[str], by: str = "source_file") -> DataFrame:
    """NULL becomes the group's median; a column that is NULL throughout stays NULL.

    The joined side is one row per file: broadcast after a check of its size, joined by
    shuffle (with adaptive splitting of a hot file) beyond it.
    """
    fitted = small_table(medians).select(by, *(q(c).alias(f"_median_{i}") for i, c in enumerate(cols)))
    joined = df.join(fitted, by, "left")
    filled = {c: F.coalesce(q(c), F.col(f"_median_{i}").cast(df.schema[c].dataType)) for i, c in enumerate(cols)}
    return joined.select(*(filled[c].alias(c) if c in filled else q(c) for c in df.columns))


def global_medians(
    df: DataFrame, cols: Sequence[str], row_no: str | None = None, chunk_rows: int | None = None
) -> DataFrame:
    """One row of medians for inference.

    Exact by default.  With ``chunk_rows`` (and an explicit 0-based ``row_no``) it is the
    row-weighted mean of the medians of consecutive chunks.
    """
    if chunk_rows is None:
        return exact_quantiles(df, [], cols, 0.5)
    if row_no is None:
        raise ValueError("chunked medians need an explicit row number column")
    chunk = F.floor(F.col(row_no) / chunk_rows)
    # Chunks are bounded by chunk_rows, so the built-in exact median is safe per chunk.
    per_chunk = df.groupBy(chunk.alias("chunk")).agg(
        F.count("*").alias("n"), *(F.median(q(c)).alias(c) for c in cols)
    )
    total = F.sum("n")
    return per_chunk.agg(*((F.sum(q(c) * F.col("n")) / total).alias(c) for c in cols))


def impute_at_inference(df: DataFrame, medians: dict[str, float], cols: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Missing or non-finite features become the stored median, or 0.0 without one."""
    filled = {c: F.coalesce(finite_or_null(q(c).cast("double")), F.lit(float(medians.get(c, 0.0)))) for c in cols}
    return df.select(*(filled[c].alias(c) if c in filled else q(c) for c in df.columns))


def drop_exact_duplicates(df: DataFrame, scope: str = "file", by: str = "source_file") -> DataFrame:
    """Drop repeated rows within one file (default) or across all files (``global``)."""
    if scope == "file":
        return df.dropDuplicates()
    if scope != "global":
        raise ValueError("scope must be 'file' or 'global'")
    return df.dropDuplicates([c for c in df.columns if c != by])


def feature_report(columns: Sequence[str], expected: Sequence[str] = FEATURE_NAMES) -> dict[str, list[str]]:
    """Column names that are missing and that are not expected."""
    return {
        "missing": [c for c in expected if c not in columns],
        "extra": [c for c in columns if c not in expected],
    }


def validate_features(df: DataFrame, expected: Sequence[str] = FEATURE_NAMES, keep: Sequence[str] = ()) -> DataFrame:
    """Features in model order after ``keep``; an error names the first missing ones."""
    missing = feature_report(df.columns, expected)["missing"]
    if missing:
        more = " ..." if len(missing) > 5 else ""
        raise ValueError(f"{len(missing)} missing feature(s): {missing[:5]}{more}")
    return df.select(*(q(c) for c in (*keep, *expected)))


def fit_standardiser(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column (a deviation of 0 counts as 1)."""
    row = df.agg(
        *(F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)),
        *(F.stddev_pop(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)),
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    scaled = {c: (q(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()}
    return df.select(*(scaled[c].alias(c) if c in scaled else q(c) for c in df.columns))


def clip_quantile(df: DataFrame, cols: Sequence[str], quantile: float = 0.99, fit_on: DataFrame | None = None) -> DataFrame:
    """Cap each column at a quantile fitted on ``fit_on`` (default: the table itself)."""
    row = exact_quantiles(df if fit_on is None else fit_on, [], cols, quantile).first()
    capped = {c: F.least(q(c), F.lit(row[c])) for c in cols if row[c] is not None}
    # least() skips NULL, so a NULL must be kept by hand.
    return df.select(
        *(F.when(q(c).isNotNull(), capped[c]).alias(c) if c in capped else q(c) for c in df.columns)
    )


def clean_table(df: DataFrame, label: str = "label", by: str = "source_file", scope: str = "file") -> DataFrame:
    """The whole cleaning plan: missing to NULL, per-file medians, duplicates, labels."""
    cols = [c for c in numeric_columns(df) if c != by]
    df = normalise_missing(df)
    df = impute_median(df, fit_medians(df, cols, by), cols, by)
    return clean_labels(drop_exact_duplicates(df, scope, by), label)
