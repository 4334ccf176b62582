"""CSV and Parquet tables of labelled flows."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.clean import normalise_missing, q
from netloom.schema import FLOW_CSV_SCHEMA

# Text that stands for a missing number.
MISSING_TOKENS = ("Infinity", "-Infinity", "inf", "-inf")


def clean_header(names: Sequence[str]) -> list[str]:
    """Trim spaces and quotes; a repeated name gets the suffix ``.1``."""
    out: list[str] = []
    for name in names:
        name = name.strip(" \"'")
        out.append(name + ".1" if name in out else name)
    return out


def _flow_files(spark: SparkSession, path: str) -> list[str]:
    """CSV files of a directory whose path holds neither ``clean`` nor ``sample``."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    keep = names.where(~F.col("path").contains("clean") & ~F.col("path").contains("sample"))
    return sorted(r.path for r in keep.collect())  # file names only; the content column is pruned


def _first_line(spark: SparkSession, path: str) -> str:
    """One line through Spark's own file system, so any store it can read will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    line = reader.readLine()
    reader.close()
    return (line or "").lstrip("\ufeff")


def _layouts(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> dict[tuple[str, ...], list[str]]:
    """Files by their cleaned header; a header that lacks a column is an error."""
    out: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        names = tuple(clean_header(next(csv.reader([_first_line(spark, path)]), [])))
        missing = [n for n in schema.names if n not in names]
        if missing:
            raise ValueError(f"{path}: the header has no column {missing[0]!r} ({len(missing)} missing)")
        out.setdefault(names, []).append(path)
    return out


def read_flow_csvs(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = FLOW_CSV_SCHEMA) -> DataFrame:
    """Union of labelled CSV files, one scan per distinct header, with ``source_file``.

    Columns are found by their cleaned name, in any order; others are left out.  Numbers are
    read as text and cast, which turns every missing token and every number that does not
    fit its type into NULL.
    """
    files = _flow_files(spark, path) if isinstance(path, str) else list(path)
    if not files:
        raise ValueError(f"no flow CSV files under {path}")

    def value(i: int, field: T.StructField) -> Column:
        c = F.col(f"c{i}")
        if not isinstance(field.dataType, T.NumericType):
            return c.alias(field.name)
        number = F.when(~F.trim(c).isin(*MISSING_TOKENS), c).try_cast(T.DoubleType())
        return number.try_cast(field.dataType).alias(field.name)

    parts = []
    for names, paths in _layouts(spark, files, schema).items():
        text = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).csv(paths)
        typed = (value(names.index(f.name), f) for f in schema)
        parts.append(raw.select(*typed, F.input_file_name().alias("source_file")))
    return normalise_missing(reduce(DataFrame.unionByName, parts))


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cleaned rows, one directory per source file."""
    by_file = df.withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))
    writer = by_file.write.mode("overwrite").partitionBy("source_file")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_split(df: DataFrame, path: str) -> None:
    """Train, validation and test rows; features and label stay together."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One split; the partition filter and the column list both reach the scan."""
    part = spark.read.parquet(path).where(F.col("split") == name)
    return part.select(*(q(c) for c in cols)) if cols else part.drop("split")


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Metrics as JSON, per-class tables and importances as CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
