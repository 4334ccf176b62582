"""The training-data pipeline: five stages over ``documents``, each on what the one before has kept.

Each stage reads the table that its predecessor wrote.  Toxic documents go, of equal texts and
of SimHash components the row with the smallest id stays, documents that hold a benchmark item go,
and the last stage mixes the sources: the documents that the mix takes, with all their columns, the number
of whole copies and of words taken (a document the mix leaves out has no row).

Rows: the stages' operators define nulls, empty texts, ties, repeated rows and empty tables;
extra columns travel along through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, exact_dedup, mixing, simhash_dedup, toxicity
from netloom.llm.common import table
from netloom.operators.stages import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The fitted scores and the fingerprints have no SQL form; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
