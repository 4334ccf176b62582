"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of ``n`` words is compared with the windows of ``n`` words of every text:
both get a 64-bit SimHash of their five-word shingles (an item with fewer words is one
shingle), a multi-index over eight blocks finds every pair within ``RADIUS`` bits (at most ``RADIUS // 8`` differing
bits in some block, and all such block values are looked up), and the exact similarity of
the weighted shingles, shared weight over joint weight with a shingle's weight its number
of occurrences, decides at ``SIMILARITY``.

Only windows that can reach that similarity are fingerprinted: a window must hold at least
``SIMILARITY`` times the item's number of shingles that occur in *some* item of its size.
This bound loses nothing, and it leaves a few windows around each suspicious passage.  Which item a
window belongs to is found by the fingerprints alone.

Words are runs of letters and digits, lower case, so case, punctuation and line breaks do
not hide a passage.  All steps are DataFrame expressions.  Of the tables made here only the
benchmark's shingles are broadcast, after they were counted (``BROADCAST`` rows at most).  The other joins on windows and shingles say
that they run by shuffle: these rows are unfolded from arrays or repeat their text, so the size that Spark expects
(of the files, or from before the unfolding) is far too low.  Copies of a text are examined once.

Rows: null or wordless texts and items match nothing; null ids are kept as they are; repeated rows give repeated
results.  Columns besides ids and ``text`` are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import text_of
from netloom.operators.stages import settle

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8
BROADCAST = 500_000
ITEM_ROWS = 100_000  # the same for shingles with their text
CHUNK = 256  # words


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), "")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text_of(text).cast("binary")))


def _hashes(words: str, width: int) -> Column:
    w = F.col(words)
    starts = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))


def sized_items(benchmark: DataFrame) -> DataFrame:
    """``item, n, width, s, words``: items with words, their size and number of shingles."""
    rows = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("n", F.size("words"))
    rows = rows.withColumn("width", F.least("n", F.lit(WIDTH)))
    return rows.withColumn("s", F.col("n") - F.col("width") + 1)


def _fingerprints(shingles: DataFrame, *key: str) -> DataFrame:
    """SimHash per key from one row per shingle (``hash``), and their number ``s``."""
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(lanes)).alias(f"c{k}") for k in range(32)]
    counted = shingles.groupBy(*key).agg(F.count(F.lit(1)).alias("s"), *sums)

    def bit(count: Column, k: int) -> Column:
        return F.when(count * 2 > F.col("s"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0))

    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"c{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"c{k}"), 32)
        fp = fp.bitwiseOR(bit(low, k)).bitwiseOR(bit(high, k + 32))
    return counted.select(*key, "s", fp.alias("fp"))


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _near_blocks(radius: int) -> list[int]:
    """All ways to flip the bits that one block can differ in."""
    most = radius // BLOCKS
    return [sum(1 << b for b in flips) for m in range(most + 1) for flips in combinations(range(8), m)]


def _indexed(prints: DataFrame, masks: list[int]) -> DataFrame:
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k).alias("value")) for k in range(BLOCKS)))
    rows = prints.withColumn("at", F.explode(blocks)).withColumn("mask", F.explode(F.array(*(F.lit(m) for m in masks))))
    return rows.withColumn("block", F.col("at.block")).withColumn("value", F.col("at.value").bitwiseXOR(F.col("mask")))


def _sized(df: DataFrame, rows: int, most: int) -> DataFrame:
    """The side of a join: broadcast if it was counted and is small, else never, whatever its size is estimated at."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``tid, n, width, s, starts``: per text and item size, the windows that could reach ``similarity``."""
    sizes = items.select("n", "width", "s").distinct()
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # five values at most
    known = [items.where(F.col("width") == w).select("n", "width", F.explode(_hashes("words", w)).alias("known")) for w in widths]
    if not known:
        known, widths = [items.select("n", "width", F.lit(0).cast("long").alias("known"))], [WIDTH]
    all_known = known[0]
    for more in known[1:]:
        all_known = all_known.unionByName(more)
    all_known = settle(all_known.distinct(), "item-shingles")
    all_known = _sized(all_known, all_known.count(), BROADCAST)
    texts = docs.select(_text_key(F.col("text")).alias("tid"), words_of(F.col("text")).alias("words"))
    per_width = F.array(*(F.struct(F.lit(w).alias("w"), _hashes("words", w).alias("hashes")) for w in widths))
    hashes = texts.select("tid", F.explode(per_width).alias("at")).select("tid", F.col("at.w").alias("w"), "at.hashes")
    shingles = hashes.select("tid", "w", F.size("hashes").alias("total"), F.posexplode("hashes").alias("pos", "hash"))
    hits = shingles.join(all_known, (F.col("hash") == F.col("known")) & (F.col("w") == F.col("width")))
    found = hits.groupBy("tid", "n").agg(F.first("total").alias("total"), F.collect_set("pos").alias("p"))
    found = found.withColumn("p", F.sort_array("p")).join(F.broadcast(sizes.withColumnRenamed("n", "of")), F.col("n") == F.col("of")).drop("of")
    # c hits at least; a run of c hits from hit i allows the starts up to hit i, and after hit i - 1
    found = found.withColumn("c", F.greatest(F.lit(1), F.ceil(F.col("s") * F.lit(similarity) - F.lit(1e-9)).cast("int")))
    starts = F.expr("""
      flatten(transform(
        filter(sequence(0, size(p) - c), i -> p[i + c - 1] - p[i] < s),
        i -> filter(
          sequence(greatest(0, p[i + c - 1] - s + 1, if(i > 0, p[greatest(i - 1, 0)] + 1, 0)), p[i]),
          k -> k + s <= total or (k = 0 and total < s))))""")
    found = found.where(F.size("p") >= F.col("c")).withColumn("starts", starts)
    # A text shorter than the item is one window.
    return found.where(F.size("starts") > 0).select("tid", "n", "width", F.least("s", "total").alias("s"), "starts")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``tid, item, start, similarity``: every window whose similarity to an item is high enough.

    ``tid`` is the 128-bit hash of the text; ``start`` counts words from 0.
    """
    items = settle(sized_items(benchmark), "items")
    spots = settle(windows(docs, items, similarity), "windows")
    suspects = spots.select(F.col("tid").alias("of")).distinct()
    keyed = docs.select(_text_key(F.col("text")).alias("tid"), "text").join(suspects, F.col("tid") == F.col("of"), "left_semi")
    texts = keyed.groupBy("tid").agg(F.first("text").alias("text")).select("tid", words_of(F.col("text")).alias("words"))

    # Texts in overlapping chunks, so that a row holds a bounded piece however long the text is.
    span = items.agg(F.max(F.col("s") + F.col("width"))).first()[0] or 1
    at = F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {CHUNK}"))
    chunks = F.transform(at, lambda c: F.struct(c.alias("chunk"), F.slice("words", c * CHUNK + 1, CHUNK + span).alias("part")))
    chunks = texts.where(F.size("words") > 0).select("tid", F.explode(chunks).alias("c")).select("tid", "c.chunk", "c.part")
    starts = spots.select(F.col("tid").alias("of"), "n", "width", "s", F.explode("starts").alias("start"))
    starts = starts.groupBy("of", "n", "width", "s", F.expr(f"start div {CHUNK}").alias("in_chunk")).agg(F.collect_list("start").alias("own"))
    placed = starts.join(chunks.hint("merge"), (F.col("of") == F.col("tid")) & (F.col("in_chunk") == F.col("chunk")))
    cut = F.transform("own", lambda x: F.struct(x.alias("start"), F.slice("part", (x - F.col("chunk") * CHUNK + 1).cast("int"), F.col("s") + F.col("width") - 1).alias("words")))
    placed = placed.select("tid", "n", "width", "s", F.explode(cut).alias("w")).select("tid", "n", "width", "s", "w.start", "w.words")

    def shingled(rows: DataFrame, *key: str) -> DataFrame:
        parts = F.expr("transform(sequence(0, s - 1), k -> array_join(slice(words, k + 1, width), ' '))")
        rows = rows.select(*key, F.explode(parts).alias("shingle"))
        return rows.withColumn("hash", F.xxhash64("shingle"))

    doc_rows = settle(shingled(placed, "tid", "n", "start"), "window-shingles")
    item_rows = settle(shingled(items, "item", "n"), "item-rows")
    doc_prints = _fingerprints(doc_rows, "tid", "n", "start")
    item_prints = _fingerprints(item_rows, "item", "n").select(
        "item", F.col("n").alias("m"), F.col("s").alias("item_s"), F.col("fp").alias("item_fp")
    )
    left = _indexed(doc_prints, [0])
    right = _indexed(item_prints.withColumnRenamed("item_fp", "fp"), _near_blocks(radius)).select(
        "item", "m", "item_s", F.col("fp").alias("item_fp"), F.col("block").alias("b"), F.col("value").alias("v")
    )
    near = left.join(right.hint("merge"), (F.col("n") == F.col("m")) & (F.col("block") == F.col("b")) & (F.col("value") == F.col("v")))
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    pairs = near.select("tid", "n", "start", "item", (F.col("s") + F.col("item_s")).alias("all")).distinct()

    weights = doc_rows.groupBy("tid", "n", "start", "shingle").agg(F.count(F.lit(1)).alias("weight"))
    item_weights = item_rows.groupBy("item", "shingle").agg(F.count(F.lit(1)).alias("item_weight"))
    item_weights = _sized(item_weights, item_rows.count(), ITEM_ROWS)
    shared = (
        pairs.join(weights.hint("merge"), ["tid", "n", "start"]).join(item_weights, ["item", "shingle"])
        .groupBy("tid", "start", "item", "all").agg(F.sum(F.least("weight", "item_weight")).alias("both"))
    )
    scored = shared.withColumn("similarity", F.col("both") / (F.col("all") - F.col("both")))
    return scored.where(F.col("similarity") >= similarity).select("tid", "item", "start", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity``: every document with the items it holds, and the best similarity."""
    found = matches(docs, benchmark, similarity, radius)
    # Written, so that both sides of the join come straight from an exchange and a hot text's rows can be split.
    best = settle(found.groupBy("tid", "item").agg(F.max("similarity").alias("similarity")), "leaks")
    ids = docs.select("doc_id", _text_key(F.col("text")).alias("of"))
    return ids.join(best, F.col("of") == F.col("tid")).select("doc_id", F.col("item").alias("item_id"), "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = settle(matches(docs, benchmark, similarity, radius).select("tid").distinct(), "leaks")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _text_key(F.col("text")).alias("of"))
    return rows.join(bad, F.col("of") == F.col("tid"), "left_anti").select("row.*")


# Every window with a shared shingle, compared directly.
SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, ws, least(5, len(ws)) AS width, len(ws) - least(5, len(ws)) + 1 AS s
 FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark)
 WHERE len(ws) > 0),
ish AS (SELECT item_id, width, s, array_to_string(ws[p + 1 : p + width], ' ') AS sh, count(*) AS c
 FROM (SELECT *, unnest(range(0, s)) AS p FROM i) GROUP BY ALL),
ds AS (SELECT rid, doc_id, width, len(ws) - width + 1 AS total, p, array_to_string(ws[p + 1 : p + width], ' ') AS sh
 FROM (SELECT w.*, width, unnest(range(0, greatest(0, len(w.ws) - width + 1))) AS p FROM w, (SELECT DISTINCT width FROM i))),
cand AS (SELECT DISTINCT rid, doc_id, item_id, width, least(s, total) AS n, s, start FROM (
 SELECT *, unnest(range(greatest(0, p - s + 1), greatest(0, least(p, total - s)) + 1)) AS start
 FROM (SELECT ds.*, item_id, s FROM ds JOIN ish USING (width, sh)))),
win AS (SELECT c.rid, c.doc_id, c.item_id, c.width, c.n, c.s, c.start, d.sh, count(*) AS c
 FROM cand c JOIN ds d ON d.rid = c.rid AND d.width = c.width AND d.p >= c.start AND d.p < c.start + c.n GROUP BY ALL),
sim AS (SELECT w.rid, w.doc_id, w.item_id, w.start, sum(least(w.c, x.c)) AS shared, any_value(w.n + w.s) AS joint
 FROM win w JOIN ish x ON x.item_id = w.item_id AND x.sh = w.sh GROUP BY ALL)
SELECT doc_id, item_id, max(shared / (joint - shared)) AS similarity FROM sim
WHERE shared / (joint - shared) >= 0.8 GROUP BY rid, doc_id, item_id
"""
