"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    licenses,
    minhash_dedup,
    mixing,
    periodic_runs,
    secret_scan,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from netloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": _over("documents", mixing.query),
    "op2_simhash_components": _over("documents", simhash_dedup.query),
    "op3_decontaminate": lambda spark, sf_dir: decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op4_exact_dedup": _over("documents", exact_dedup.query),
    "op5_toxicity": lambda spark, sf_dir: toxicity.query(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ),
    "op6_license_scan": _over("documents", licenses.query),
    "op7_suffix_dedup": _over("documents", suffix_dedup.query),
    "op8_url_filter": _over("pages", url_filter.query),
    "op9_token_counts": _over("documents", token_counts.query),
    "op10_secret_scan": _over("documents", secret_scan.query),
    "op11_minhash_dedup": _over("documents", minhash_dedup.query),
    "op12_conversation_repair": _over("conversations", conversation_repair.query),
    "op13_periodic_runs": _over("documents", periodic_runs.query),
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_url_filter": url_filter.SQL,
}
