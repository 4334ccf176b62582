"""SimHash near-duplicates through sharded vantage-point trees.

Each text becomes a 64-bit SimHash of its word shingles.  The distinct fingerprints are
partitioned by a vantage-point tree: a node sends a fingerprint left if its Hamming
distance to the node's point is at most ``mu + r`` and right if it is above ``mu``.  By the triangle
inequality, two fingerprints at most ``r`` bits apart have distances to a point that differ
by at most ``r``, so every such pair meets in some shard; fingerprints near a boundary sit on
both sides.  Inside a shard a vantage-point tree with small leaves holds every fingerprint once, and each fingerprint searches
it, leaving out branches that the same bound excludes.  A shard larger than planned (very many different
fingerprints around one point) is searched as a grid of part pairs, spread over tasks.
A shard reports a spanning forest of its links, not the pairs; components join the forests.

The tree of the shards is fitted on at most ``SAMPLE`` fingerprints.  It decides where comparisons happen,
never their outcome.  Copies share a fingerprint and take part once.  At 3 bits of 64 the bound prunes modestly: distances
to a point lie within a few bits of 32, so about three in ten fingerprints sit on both sides of a node.

Rows: null counts as empty, and all texts without a word have fingerprint zero; a null id is
never the smallest unless all ids of a component are null; repeated rows each give a row.
Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import known, whole_row
from netloom.llm.components import components
from netloom.operators.stages import settle

WIDTH = 3
RADIUS = 3
SEED = 42
LEAF = 32_768  # fingerprints of a shard: a few seconds of search, and fewer boundaries to copy for
NODE = 256  # fingerprints of a leaf inside a shard
SAMPLE = 65_536
PIECE = 65_536  # shingles whose bits are counted at a time
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, width: int = WIDTH) -> int:
    """Majority bits of the shingles' XXH64; the whole text's where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, PIECE):
        end = min(n, at + PIECE)
        runs = zip(*(words[at + k : end + k] for k in range(min(width, len(words)))), strict=False)
        raw = b"".join([digest(b" ".join(run), SEED) for run in runs])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit number."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((simhash(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {id_type}, fp long")


class Tree:
    """Points, radii and children of a vantage-point tree in flat arrays; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: int, radius: int, rng: np.random.Generator):
        self.radius = radius
        self.points: list[int] = []
        self.mus: list[int] = []
        self.children: list[tuple[int, int]] = []  # below zero: leaf -1 - child
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng)

    def _grow(self, own: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        best = None
        if len(own) > leaf:
            for point in rng.choice(own, min(8, len(own)), replace=False):
                counts = np.bincount(np.bitwise_count(own ^ point), minlength=65).cumsum()
                left = np.concatenate([counts[self.radius :], np.full(self.radius, counts[-1])])
                sizes = np.maximum(left, counts[-1] - counts)
                mu = int(sizes.argmin())
                if best is None or sizes[mu] < best[0]:
                    best = (int(sizes[mu]), int(point), mu)
        if best is None or best[0] > 0.95 * len(own):
            self.leaves += 1
            return -self.leaves
        _, point, mu = best
        node = len(self.points)
        self.points.append(point)
        self.mus.append(mu)
        self.children.append((0, 0))
        d = np.bitwise_count(own ^ np.uint64(point)).astype(np.int64)
        self.children[node] = (
            self._grow(own[d <= mu + self.radius], leaf, rng), self._grow(own[d > mu], leaf, rng)
        )
        return node

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (fingerprint, leaf) it belongs to."""
        out_fp, out_leaf, todo = [], [], [(self.root, fps)]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                out_fp.append(own)
                out_leaf.append(np.full(len(own), -1 - node, np.int32))
                continue
            d = np.bitwise_count(own ^ np.uint64(self.points[node])).astype(np.int64)
            left, right = self.children[node]
            todo += [(left, own[d <= self.mus[node] + self.radius]), (right, own[d > self.mus[node]])]
        if not out_fp:
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        return np.concatenate(out_fp), np.concatenate(out_leaf)


def fit_tree(distinct: DataFrame, radius: int, leaf: int = LEAF, sample: int = SAMPLE) -> Tree:
    """A tree whose leaves hold about ``leaf`` fingerprints, from at most ``sample`` of them."""
    total = distinct.count()
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    own = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    share = len(own) / total if total else 1.0
    return Tree(own, max(32, int(leaf * share)), radius, np.random.default_rng(SEED))


def search(rows: np.ndarray, cols: np.ndarray, radius: int, leaf: int = NODE, block: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (row, column) of all pairs at most ``radius`` bits apart, by a vantage-point tree over ``cols``.

    A node splits its columns at the distance ``mu`` to its point; rows go down to the side that the triangle
    inequality leaves possible, or to both.
    """
    rng = np.random.default_rng(SEED)
    todo = [(np.arange(len(cols)), np.arange(len(rows)))]
    while todo:
        own, asks = todo.pop()
        if not len(own) or not len(asks):
            continue
        best = None
        if len(own) > leaf:
            for point in cols[rng.choice(own, 4)]:
                d = np.bitwise_count(cols[own] ^ point)
                counts = np.bincount(d, minlength=65).cumsum()
                mu = int(np.abs(2 * counts - len(own)).argmin())
                larger = max(int(counts[mu]), len(own) - int(counts[mu]))
                if best is None or larger < best[0]:
                    best = (larger, point, mu, d)
        if best is None or best[0] > 0.95 * len(own):  # a leaf, or columns that no point of them separates
            for at in range(0, len(asks), block):
                part = asks[at : at + block]
                for low in range(0, len(own), block):
                    i, j = (np.bitwise_count(rows[part, None] ^ cols[None, own[low : low + block]]) <= radius).nonzero()
                    if len(i):
                        yield part[i], own[low + j]
            continue
        _, point, mu, d = best
        away = np.bitwise_count(rows[asks] ^ point).astype(np.int64)
        todo += [(own[d <= mu], asks[away <= mu + radius]), (own[d > mu], asks[away > mu - radius])]


def forest(fps: np.ndarray, other: np.ndarray | None, radius: int, leaf: int = NODE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within ``fps`` (or between it and ``other``) connect."""
    nodes = np.unique(fps if other is None else np.concatenate([fps, other]))
    rows = np.unique(fps)
    cols = rows if other is None else np.unique(other)
    row_at, col_at = np.searchsorted(nodes, rows), np.searchsorted(nodes, cols)
    label = np.arange(len(nodes))
    parent = {}

    def root(x: int) -> int:
        path = []
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            parent[p] = x
        return x

    for i, j in search(rows, cols, radius, leaf):
        a, b = label[row_at[i]], label[col_at[j]]
        new = a != b
        if new.any():
            for x, y in np.unique(np.stack([a[new], b[new]]), axis=1).T.tolist():
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            found = np.unique(label)
            to = np.array([root(int(x)) for x in found])
            label = to[np.searchsorted(found, label)]
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: a forest that connects all fingerprints (``fp``) with links of ``radius`` bits."""
    spark = distinct.sparkSession
    tree = fit_tree(distinct, radius, leaf, sample)

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps, leaves = tree.route(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for at in range(0, len(fps), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(fps[part].view(np.int64)), pa.array(leaves[part])], ["fp", "leaf"])

    homes = settle(distinct.mapInArrow(route, "fp long, leaf int"), "vp-homes")
    # One row per leaf; the sample bounds their number.
    sizes = homes.groupBy("leaf").count().collect()
    parts = {r["leaf"]: ceil(r["count"] / (2 * leaf)) for r in sizes}
    grid = spark.createDataFrame(list(parts.items()) or [(0, 1)], "of int, parts int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.expr("transform(sequence(0, parts - 1), k -> named_struct('i', least(own, k), 'j', greatest(own, k)))")
    dealt = (
        homes.join(F.broadcast(grid), F.col("leaf") == F.col("of")).withColumn("own", own)
        .select("leaf", "fp", "own", F.explode(meets).alias("at")).select("leaf", "fp", "own", "at.i", "at.j")
    )

    def compare(t: pa.Table) -> pa.Table:
        fps = t.column("fp").to_numpy().view(np.uint64)
        if not len(fps):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
        a, b = forest(fps[own == i], None if i == j else fps[own == j], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, fp, component_id, root``: the smallest id reachable over links of ``radius`` bits, and the component's smallest fingerprint."""
    prints = settle(fingerprints(docs, width), "simhash")
    per = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    hung = settle(components(links(per.select("fp"), radius, leaf, sample)), "simhash-roots")
    rooted = per.join(hung, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("of"), "component_id", "root")
    return prints.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id", "root")


def keep_first(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Among rows of a component that share the smallest id, the smallest fingerprint and then the smallest hash of the text decide, and
    of equal rows one stays.  Rows with a null id stay only where no id of the component is known.
    """
    found = near_components(docs, width, radius)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # A component without ids is known by its fingerprints alone; they meet in `root`.
    kept = first.groupBy("root").agg(F.first("doc_id").alias("id"), F.min("fp").alias("kept_fp")).select(
        known(F.col("id")).alias("kept_id"), "kept_fp"
    )
    whole = with_fingerprints(docs, width).withColumn("id", known(F.col("row.doc_id")))
    stays = whole.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi")
    # The grouping keeps the join's partitioning, and copies of a row are combined before any exchange.
    text = F.xxhash64(F.col("row.text").cast("string"))
    return stays.groupBy("id", "fp").agg(F.min_by("row", text).alias("row")).select("row.*")


def with_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``row, fp``: every row as a struct, with its fingerprint."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((simhash(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["row", "fp"])

    df = docs.select(whole_row(docs), F.col("text").cast("string").alias("said"))
    return df.mapInArrow(batches, T.StructType([df.schema["row"], T.StructField("fp", T.LongType())]))


def query(docs: DataFrame) -> DataFrame:
    found = near_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
