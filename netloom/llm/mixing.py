"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the words by weight, at most ``epochs`` times its own size.
Sources above their cap are clamped, their excess goes to the others by weight, and this
repeats until no source is above: every round is one aggregation over the table of
sources, and the driver holds two sums only.  The documents of a source are then taken
``floor(target / size)`` times whole, and one more time in the order of a seeded hash until
the target is reached; the document at the border is taken in part, so a source meets its
target to the word.

That order needs no sort of a whole source: its words are summed per hash bucket, the
buckets are accumulated, and only the bucket that holds the border is ordered.  A hot source is thus spread over
``BUCKETS`` groups.  The table of sources (one row each) is numbered in one task, because the
weights repeat along the order of all names.

Rows: a null text has size 0; a null source is a source of its own, last in the order; null or repeated ids take
part as rows of their own (ties go to the smaller size, equal rows are interchangeable).
With no words at all every target is 0.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import WORD, known, text_of, whole_row
from netloom.operators.stages import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-42"
BUCKETS = 4096


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, draw, mark``: words of each document, its place in the draw and a hash of its text."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    size = F.regexp_count(text_of(F.col("text")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), draw.alias("draw"), F.xxhash64(text_of(F.col("text"))).alias("mark"))


def weighted(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``source, source_size, weight``: weights repeat along the sources, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)


def fill(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target``: shares by weight, clamped at ``epochs`` times the size.

    ``share`` is the sum of the targets as a multiple of all sizes; at or above ``epochs``
    every source is clamped.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = None, -1
    while True:
        # A source stays clamped once it is: the level only rises.
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        sums = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.sum(F.when(above, 1).otherwise(0)),
        ).first()
        if sums[2] is None or sums[2] == clamped or not sums[1]:
            break
        level, clamped = (share * total - sums[0]) / sums[1], sums[2]
    rise = F.lit(0.0 if level is None else level) * F.col("weight")
    return sources.withColumn("target", F.least(cap, rise).cast("double"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` whole repetitions and ``taken - copies * size`` leading words once more.
    """
    return _shares(docs, weights, share, epochs, seed).drop("mark")


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies`` and ``taken`` as in :func:`mix` (in place of own ones).

    Rows are found again by id and text; the shares of rows that repeat both are dealt among them, in one task.
    """
    shares = _shares(docs, weights, share, epochs, seed).groupBy(known(F.col("doc_id")).alias("of"), F.col("mark").alias("of_mark")).agg(
        F.sort_array(F.collect_list(F.struct("taken", "copies")), asc=False).alias("shares")
    )
    rows = docs.select(whole_row(docs), known(F.col("doc_id")).alias("id"), F.xxhash64(text_of(F.col("text"))).alias("mark"))
    found = rows.join(shares, (F.col("id") == F.col("of")) & (F.col("mark") == F.col("of_mark")))
    nth = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.lit(1)))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("copies", "taken")]
    got = found.withColumn("got", F.element_at("shares", nth)).where("got.taken > 0")
    return got.select(*own, "got.copies", "got.taken")


def _shares(docs: DataFrame, weights, share: float, epochs: int, seed: str) -> DataFrame:
    rows = settle(sized(docs, seed).withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")), "mix-sizes")
    sources = settle(weighted(rows, weights), "mix-sources")
    plan = fill(sources, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", whole).withColumn(
        "more", F.round("target").cast("long") - F.col("copies") * F.col("source_size")
    )
    spent = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heaps = (
        rows.groupBy("source", "bucket").agg(F.sum("size").alias("heap"))
        .withColumn("before", F.coalesce(F.sum("heap").over(spent), F.lit(0)))
        .withColumnsRenamed({"source": "of", "bucket": "of_bucket"})
    )
    heaps = heaps.join(plan.withColumnRenamed("source", "src"), F.col("of").eqNullSafe(F.col("src"))).drop("src")
    # left: words the draw still wants when it comes to this bucket
    heaps = settle(heaps.withColumn("left", F.col("more") - F.col("before")), "mix-heaps")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket"))
    split = (F.col("left") > 0) & (F.col("left") < F.col("heap"))
    plain = rows.join(heaps.where(~split), same).withColumn(
        "extra", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0))
    )
    run = Window.partitionBy("of", "of_bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    border = rows.join(heaps.where(split), same).withColumn("left", F.col("left") - F.coalesce(F.sum("size").over(run), F.lit(0)))
    border = border.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left"))))
    return plain.unionByName(border).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"), "mark",
    )


SQL = r"""
WITH n AS (
 SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  md5(concat('mix-42:', coalesce(CAST(doc_id AS VARCHAR), '-'))) AS draw
 FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
  WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s),
r AS (SELECT *, 2e0 * source_size / weight AS level FROM w),
-- levels with all sources up to this one clamped; the first that clamps no further source holds
p AS (SELECT level,
  (1.5e0 * (SELECT sum(source_size) FROM s)
    - coalesce(2e0 * sum(source_size) OVER before, 0)) / (sum(weight) OVER rest) AS fill
 FROM r WINDOW before AS (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  rest AS (ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT max(fill) AS fill FROM p WHERE fill <= level),
t AS (SELECT source, source_size, least(2e0 * source_size, fill * weight) AS target FROM r, f),
c AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM t),
d AS (SELECT n.doc_id, n.source, n.size, c.source_size, c.target, c.copies,
  CAST(round(c.target) AS BIGINT) - c.copies * c.source_size
   - coalesce(sum(n.size) OVER (PARTITION BY n.source ORDER BY n.draw, n.doc_id, n.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want
 FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, copies,
 CAST(copies * size + greatest(0, least(size, want)) AS BIGINT) AS taken
FROM d
"""


def query(docs: DataFrame) -> DataFrame:
    return mix(docs)
