"""Column fragments that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def known(doc_id: Column) -> Column:
    """An id as a key without nulls, so that joins and groupings on it share their partitioning."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct: inner names cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
