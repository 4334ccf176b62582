"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact sets, star components.

A document's set holds the hashes of its distinct word shingles.  ``HASHES`` functions ``a * x + b`` modulo
2**64 with odd ``a`` keep their minima, 16 bits of each form the signature, and ``ROWS`` neighbouring
minima form a band.  The work on top of it has two levels:

* *candidates*: sets that share a band meet in its bucket, where their signatures are compared; a bucket reports a
  forest of the pairs that agree in ``AGREE`` minima, and components join the forests to clusters;
* *links*: the full sets of a cluster meet, pairs that agree in ``AGREE`` minima and are not connected yet are confirmed by
  the exact ratio of intersection and union, and the forests of these links give the components.

So a set travels once per cluster and not once per band or pair, and a group of near copies costs about
one comparison for each member.  Equal sets are one node.  Buckets and clusters above a fixed size are compared as a
grid of blocks over several tasks.

A pair at the threshold shares no band with probability 2e-8 ((1 - 0.85**4)**24) and misses the agreement with 4e-8;
both fall quickly above it.  Nothing else is left to chance.

Rows: a null text is empty; documents without words are linked with nothing and form their own component; with
fewer words than the shingle width the whole sequence is one shingle.  A null id is larger than any
other and kept only if all ids of its component are null.  Repeated rows each give a row.  An empty table gives an
empty result.  Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.streams import runs
from netloom.operators.stages import settle

WIDTH = 5
PERCENT = 85
ROWS = 4
BANDS = 24
HASHES = ROWS * BANDS
AGREE = 60
BUCKET = 2048  # signatures of one side of a block
CLUSTER = 1 << 20  # shingles of one side of a block
PIECE = 1 << 15  # shingles whose minima are taken at a time
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; empty without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h, width = word_hashes(words), min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _ODD + h[k : k + n]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit minima for every set; zeros for an empty one."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    own = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(own):
        end, size = at, 0
        while end < len(own) and (not size or size + len(sets[own[end]]) <= PIECE):
            size += len(sets[own[end]])
            end += 1
        part = [sets[k] for k in own[at:end]]
        x, starts = np.concatenate(part), np.cumsum([0] + [len(p) for p in part[:-1]])
        y, low = np.empty_like(x), np.empty((len(part), HASHES), np.uint64)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=y)
            np.add(y, _B[k], out=y)
            low[:, k] = np.minimum.reduceat(y, starts)
        out[own[at:end]] = (low >> np.uint64(36)).astype(np.uint16)
        at = end
    return out


def _set_id(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def prints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, mark, node, n, sig``: hash of the text, hash and size of its set, signature."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                sets = [shingle_set(t, width) for t in texts]
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0),
                    pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                    pa.array([_set_id(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ], ["doc_id", "mark", "node", "n", "sig"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("doc_id", F.col("text").cast("string").cast("binary"))
    return text.mapInArrow(batches, f"doc_id {id_type}, mark binary, node binary, n long, sig binary")


def spanning(own: np.ndarray, side: np.ndarray | None, near: Callable[[int, np.ndarray], Iterator[int]]) -> list[tuple[int, int]]:
    """Edges that connect what links among ``own`` (or between it and ``side``) connect.

    ``near(x, others)`` yields the numbers among ``others`` that link with ``x``; it is asked only about others that
    are not connected with ``x`` yet, and each link found at once counts.
    """
    size = int(max(own.max(initial=-1), -1 if side is None else side.max(initial=-1))) + 1
    label, edges = np.arange(size), []
    for k, x in enumerate(own.tolist()):
        others = own[k + 1 :] if side is None else side
        others = others[label[others] != label[x]]
        if len(others):
            for y in near(x, others):
                if label[y] != label[x]:
                    edges.append((x, y))
                    label[label == label[y]] = label[x]
    return edges


def agreeing(sig: np.ndarray, sizes: np.ndarray, x: int, others: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Those of ``others`` whose signature agrees with that of ``x`` and whose size allows the ratio."""
    fits = np.minimum(sizes[others], sizes[x]) * 100 >= percent * np.maximum(sizes[others], sizes[x])
    others = others[fits]
    return others[(sig[others] == sig[x]).sum(axis=1) >= AGREE] if len(others) else others


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the ratio of intersection and union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _meet(members: DataFrame, group: str, compare: Callable[[pa.Table, np.ndarray, np.ndarray | None], list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: edges found by ``compare`` in every group of ``members`` (``node, parts`` and more columns).

    A group in ``parts`` parts is compared as a grid of blocks, each with two parts (or one with itself).
    """
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.expr("transform(sequence(0, parts - 1), k -> named_struct('i', least(own, k), 'j', greatest(own, k)))")
    rest = [c for c in members.columns if c not in (group, "parts")]
    dealt = (
        members.withColumn("own", own).withColumn("at", F.explode(meets))
        .select(group, "at.i", "at.j", "own", *rest)
        .repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for block in runs(it, 3):
            i, j, side = block.column(1)[0].as_py(), block.column(2)[0].as_py(), block.column(3).to_numpy()
            first, second = np.flatnonzero(side == i), None if i == j else np.flatnonzero(side == j)
            nodes = block.column("node")
            for x, y in compare(block, first, second):
                a.append(nodes[x].as_py())
                b.append(nodes[y].as_py())
            if len(a) >= 10_000:
                yield found()
                a, b = [], []
        yield found()

    return dealt.mapInArrow(batches, "a binary, b binary")


def _stack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def candidates(distinct: DataFrame, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """Edges between sets (``node, n, sig``) that share a band and agree in enough minima."""
    key = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    bands = distinct.select("node", F.explode(key).alias("key"))
    full = bands.groupBy(F.col("key").alias("of")).count().where("count > 1")
    parts = F.ceil(F.col("count") / bucket).cast("int")
    homes = bands.join(full, F.col("key") == F.col("of")).select("key", F.col("node").alias("home"), parts.alias("parts"))
    members = homes.join(distinct, F.col("home") == F.col("node")).select("key", "parts", "node", "n", "sig")

    def compare(block: pa.Table, own: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
        sizes, sig = block.column("n").to_numpy(), _stack(block.column("sig"), np.uint16)
        return spanning(own, side, lambda x, others: iter(agreeing(sig, sizes, x, others, percent).tolist()))

    return _meet(members, "key", compare)


def _rooted(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of an edge table, roots included."""
    hung = components(edges)
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())


def _texts(docs: DataFrame) -> DataFrame:
    """``text_mark, text``: every text once for each task that reads it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in it:
            marks, texts = [], []
            for text in batch.column(0).to_pylist():
                mark = xxhash.xxh3_128_digest(text)
                if mark not in seen:
                    seen.add(mark)
                    marks.append(mark)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(texts, pa.binary())], ["text_mark", "text"])

    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(batches, "text_mark binary, text binary")


def links(
    docs: DataFrame, distinct: DataFrame, width: int = WIDTH, percent: int = PERCENT,
    bucket: int = BUCKET, cluster: int = CLUSTER,
) -> DataFrame:
    """``a, b``: a forest that connects all sets with links, every edge confirmed on the full sets."""
    near = settle(_rooted(settle(candidates(distinct, percent, bucket), "minhash-near")), "minhash-clusters")
    home = near.select(F.col("node").alias("of"), "root").join(distinct.select("node", "mark", "n"), F.col("of") == F.col("node"))
    home = settle(home.select("node", "mark", "n", "root"), "minhash-members")
    sizes = home.groupBy(F.col("root").alias("top")).agg(F.ceil(F.sum("n") / cluster).cast("int").alias("parts"))
    members = home.join(sizes, F.col("root") == F.col("top")).select("node", "mark", "root", "parts")
    texts = _texts(docs).join(members, F.col("text_mark") == F.col("mark")).select("root", "parts", "node", "text")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                new = []
                for k, node in enumerate(batch.column(2).to_pylist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(k)
                batch = batch.take(pa.array(new, pa.int64()))
                own = [shingle_set(t, width) for t in batch.column(3).to_pylist()]
                sig = signatures(own)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())],
                    ["root", "parts", "node", "sig", "own_set"],
                )

    full = texts.mapInArrow(sets, "root binary, parts int, node binary, sig binary, own_set binary")

    def compare(block: pa.Table, own: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
        sets, sig = [np.frombuffer(s, np.uint64) for s in block.column("own_set").to_pylist()], _stack(block.column("sig"), np.uint16)
        sizes = np.array([len(s) for s in sets])

        def near(x: int, others: np.ndarray) -> Iterator[int]:
            return (y for y in agreeing(sig, sizes, x, others, percent).tolist() if linked(sets[x], sets[y], percent))

        return spanning(own, side, near)

    return _meet(full, "root", compare)


def near_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bucket: int = BUCKET, cluster: int = CLUSTER
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; the row with the component's smallest id is kept."""
    rows = settle(prints(docs, width), "minhash-prints")
    distinct = settle(
        rows.where("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("low"), F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("sig").alias("sig")
        ),
        "minhash-sets",
    )
    hung = settle(components(settle(links(docs, distinct, width, percent, bucket, cluster), "minhash-links")), "minhash-roots")
    hung = hung.select(F.col("node").alias("of"), "root")
    rooted = distinct.join(hung, F.col("node") == F.col("of"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = settle(rooted.join(ids, "root").select(F.col("node").alias("of"), "component_id"), "minhash-named")
    return rows.join(named, F.col("node") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), _component(), F.col("doc_id").eqNullSafe(_component()).alias("kept")
    )


def _component() -> Column:
    return F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")


def query(docs: DataFrame) -> DataFrame:
    return near_components(docs)
