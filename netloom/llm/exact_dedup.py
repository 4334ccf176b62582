"""Exact deduplication by content hash, with the bytes compared inside every hash group.

Method: rows are grouped by the 128-bit hash of the normalised text *and* the text itself.
The hash spreads the rows, and the aggregation compares the bytes of the texts that meet under one hash,
so a collision makes two groups.  The grouping is combined on the map side: a text that a third of the rows repeat
reaches the exchange once per map task.  Each group is then named by (hash, SHA-256), and
two different texts with both digests equal would stop the job instead of merging.

Rows: null text counts as empty; a null id is larger than any other; rows that repeat both id and text are
indistinguishable, so one of them stays.  An empty table gives an empty result.  Columns
besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import SPACE, known, text_of, whole_row
from netloom.operators.stages import settle


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _digests(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    t = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("t"))
    return t.select("doc_id", "t", hashed(F.col("t")).alias("h"))


def equal_texts(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per different text: ``h, sha, keep_id, group_size``."""
    groups = _digests(docs, hashed).groupBy("h", "t").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    named = groups.select("h", F.unhex(F.sha2(F.col("t"), 256)).alias("sha"), "keep_id", "group_size")
    alone = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("different texts share both digests")))
    return named.groupBy("h", "sha").agg(
        F.first("keep_id").alias("keep_id"),
        F.first("group_size").alias("group_size"),
        alone.cast("int").alias("clash"),
    )


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every row with its group: ``doc_id, h, sha, keep_id, group_size, kept``."""
    ids = settle(
        _digests(docs, hashed).select("doc_id", "h", F.unhex(F.sha2(F.col("t"), 256)).alias("sha")), "exact-digests"
    )
    # Before the join: a window after it would tie a hot text's rows to one task.
    copy = F.row_number().over(Window.partitionBy("doc_id", "h", "sha").orderBy(F.lit(1)))
    # Written, so that both sides of the join come straight from an exchange and a hot text's rows can be split.
    groups = settle(equal_texts(docs, hashed).where(F.col("clash").isNull()).drop("clash"), "exact-groups")
    return (
        ids.withColumn("copy", copy)
        .join(groups, ["h", "sha"])
        .select(
            "doc_id", "h", "sha", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        )
    )


def drop_copies(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text one stays.

    The rows are shuffled once: the grouping behind the join keeps its partitioning.
    """
    leaders = settle(equal_texts(docs, hashed).where(F.col("clash").isNull()).select("h", "sha", "keep_id"), "exact-leaders")
    kept = leaders.select(known(F.col("keep_id")).alias("kept_id"), F.col("h").alias("kept_h"), F.col("sha").alias("kept_sha"))
    t = normalised(F.col("text"))
    rows = docs.select(
        whole_row(docs), known(F.col("doc_id")).alias("id"), hashed(t).alias("h"), F.unhex(F.sha2(t, 256)).alias("sha")
    )
    same = (F.col("id") == F.col("kept_id")) & (F.col("h") == F.col("kept_h")) & (F.col("sha") == F.col("kept_sha"))
    stays = rows.join(kept, same, "left_semi")
    return stays.groupBy("id", "h", "sha").agg(F.first("row").alias("row")).select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 (doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t)
  AND row_number() OVER (PARTITION BY t, doc_id) = 1) AS kept,
 sha256(t) AS text_sha256
FROM n
"""


def query(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
