"""Maximal word runs by maximal pairs over an LCP-interval tree.

A maximal pair is two equal word strings that neither the words before nor the words after them
prolong.  A pair at distance ``d`` whose common length ``l`` is at least ``d`` covers a stretch of ``d + l``
words with period ``d``, and because the pair is maximal so is the stretch: pairs with ``d <= l`` and ``d + l >= SHORTEST``
are exactly the runs (and their multiples, which cover the same stretch at a larger distance).

For each text the suffixes are ranked by doubling, neighbours' common prefixes are read from the ranks,
and the intervals of common prefix are joined bottom-up, the smaller into the larger.  An interval keeps its
positions sorted, as a whole and by the word on their left; a position of the smaller side looks up the positions of other
left words within the common length, so nothing is extended and occurrences far apart are never paired.
A run needs a common length of six words or more, and a group of suffixes that share six words
with one left word alone yields none: both are left out before the tree, which leaves few positions of ordinary texts.

Every text is handled by itself where it is read; nothing is shuffled, and a task holds one Arrow batch
and the arrays of one text besides.

Rows: a null text has no words; a null id has no decimal form and its text is never rewritten; repeated rows each give a
row; an empty table gives an empty result.  Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 12
SLICE = 128  # texts looked at together for repeated strings
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the planted repetition that the id calls for."""
    n = len(words)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def with_repeats(texts: list[list[bytes]], depth: int) -> np.ndarray:
    """Which texts may hold a string of ``depth`` words twice (by hashes: every one that does, hardly another)."""
    sizes = np.array([len(w) for w in texts], np.int64)
    h = _hashes([x for words in texts for x in words])
    found = np.zeros(len(texts), bool)
    n = len(h) - depth + 1
    if n > 0:
        of = np.repeat(np.arange(len(texts)), sizes)
        gram = of[:n].astype(np.uint64) * _ODD
        for k in range(depth):
            gram = gram * _ODD + h[k : k + n]
            gram ^= gram >> np.uint64(29)
        inside = np.flatnonzero(of[:n] == of[depth - 1 :])
        order = inside[np.argsort(gram[inside])]
        same = order[1:][gram[order][1:] == gram[order][:-1]]
        found[of[same]] = True
    return found


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for every different word."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` and the common prefix of each suffix with its predecessor (0 for the first)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    ranks, span = [rank], 1
    order = np.argsort(rank, kind="stable")
    while span < n and rank.max(initial=0) < n:
        key = rank * (n + 1)
        key[: n - span] += rank[span:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + (ordered[1:] != ordered[:-1]).cumsum()])
        ranks.append(rank)
        span *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        padded = np.append(ranks[level], 0)
        x, y = padded[np.minimum(a, n)], padded[np.minimum(b, n)]
        step = np.where((x == y) & (x > 0), 1 << level, 0)
        a += step
        b += step
    common[1:] = a - order[:-1]
    return order, common


class _Group:
    """Positions of an LCP interval: all of them, and by the word on their left."""

    __slots__ = ("all", "by")

    def __init__(self, position: int, left: int):
        self.all = [position]
        self.by = {left: [position]}


def _put(into: list[int], new: list[int]) -> None:
    if new[0] > into[-1]:
        into.extend(new)
    else:
        for x in new:
            insort(into, x)


def _join(one: _Group, two: _Group, depth: int, shortest: int, found: dict[tuple[int, int], int]) -> _Group:
    """Both groups as one interval of common length ``depth``; maximal pairs near enough go to ``found``."""
    small, large = (one, two) if len(one.all) <= len(two.all) else (two, one)
    if len(small.by) > 1 or len(large.by) > 1 or small.by.keys() != large.by.keys():
        for left, positions in small.by.items():
            for p in positions:
                low, high = bisect_left(large.all, p - depth), bisect_right(large.all, p + depth)
                if low == high:
                    continue
                if high - low <= 4 * len(large.by):
                    same = large.by.get(left)
                    near = [x for x in large.all[low:high] if same is None or same[min(bisect_left(same, x), len(same) - 1)] != x]
                else:
                    near = [
                        x for other, xs in large.by.items() if other != left
                        for x in xs[bisect_left(xs, p - depth) : bisect_right(xs, p + depth)]
                    ]
                for x in near:
                    start, d = (x, p - x) if x < p else (p, x - p)
                    if d + depth >= shortest:
                        at = (start, d + depth)
                        if d < found.get(at, d + 1):
                            found[at] = d
    _put(large.all, small.all)
    for left, positions in small.by.items():
        if left in large.by:
            _put(large.by[left], positions)
        else:
            large.by[left] = positions
    return large


def find_runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period."""
    depth = -(-shortest // 2)
    found: dict[tuple[int, int], int] = {}
    if len(ids) < shortest:
        return []
    order, common = suffixes(ids)
    before = np.unique(ids, return_inverse=True)[1]
    left = np.concatenate([[-1], before[:-1]])[order]
    deep = common >= depth
    diverse = deep.copy()
    diverse[1:] &= left[1:] != left[:-1]
    block = np.cumsum(~deep)  # suffixes that share `depth` words with the one before continue its block
    for number in np.unique(block[diverse]).tolist():
        low, high = np.searchsorted(block, [number, number + 1])
        stack: list[tuple[int, _Group]] = []
        for p, c, w in zip(order[low:high].tolist(), common[low:high].tolist(), left[low:high].tolist(), strict=True):
            while len(stack) > 1 and stack[-1][0] >= c:
                length, group = stack.pop()
                outer, other = stack[-1]
                stack[-1] = (outer, _join(other, group, length, shortest, found))
            stack.append((c, _Group(p, w)))
        while len(stack) > 1:
            length, group = stack.pop()
            outer, other = stack[-1]
            stack[-1] = (outer, _join(other, group, length, shortest, found))
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside of every run's repetitions."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(change[:-1].cumsum() == 0).tolist()]


def text_runs(docs: DataFrame, shortest: int = SHORTEST, rewrite: bool = False) -> DataFrame:
    """``doc_id, runs, words, text`` per row: its runs, the word count and the text without the repetitions.

    ``rewrite`` plants the repetition of :func:`rewritten` first.
    """
    depth = -(-shortest // 2)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
                if rewrite:
                    texts = [rewritten(w, i) for w, i in zip(texts, batch.column(0).to_pylist(), strict=True)]
                repeats = with_repeats(texts, depth).tolist()
                runs = [find_runs(numbered(w), shortest) if r else [] for w, r in zip(texts, repeats, strict=True)]
                kept = [b" ".join(collapsed(w, r)) for w, r in zip(texts, runs, strict=True)]
                flat = [x for r in runs for x in r]
                ends = np.cumsum([0] + [len(r) for r in runs])
                fields = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), found, pa.array([len(w) for w in texts], pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "runs", "words", "text"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary")).mapInArrow(
        batches, f"doc_id {id_type}, runs array<struct<start:bigint,length:bigint,period:bigint>>, words long, text binary"
    )


def query(docs: DataFrame) -> DataFrame:
    found = text_runs(docs, rewrite=True)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
