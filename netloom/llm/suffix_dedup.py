"""Removal of byte strings that documents with smaller ids hold, by partitioned suffix arrays.

Every ``LENGTH``-byte string is routed by its *anchor*, the ``GRAM``-byte string inside it with the
smallest hash: equal strings have equal anchors, so they meet in one bucket.  Consecutive strings with the same anchor
travel together as one segment (at most ``2 * LENGTH - GRAM`` bytes).  Equal segments of one text travel once, with all their places, so
texts that repeat themselves stay small.  Segments that several documents of one task
share are settled there: the document with the smallest id keeps it and represents the others, so
a passage that a third of all rows hold reaches its bucket once per task.

A bucket keeps the strings whose hash occurs in two documents, builds the suffix array of
that text in two stages (only suffixes smaller than their successors are sorted directly;
scanning the buckets of first bytes in order induces the rest), and compares neighbours: a run with common
prefixes of ``LENGTH`` bytes or more is one repeated string, which the smallest id keeps.
The removed ranges go back to their documents.

Buckets hold about ``BUCKET`` bytes of text each, so their number grows with the corpus; ``GROUP`` of
them are packed together, which compresses better, and compared one after another.  The share of a common gram
would grow with the corpus: the strings of anchors that weigh more than ``HOT`` bytes by the weights in about ``SAMPLE``
bytes of text are routed by the anchors of a longer gram instead.  The sample decides where strings meet,
never which are equal.  A bucket that is larger than ``LIMIT`` all the same is compared in parts, dealt by
longer grams too, so the memory of the comparison does not depend on how common an anchor is.  Long
texts are cut into overlapping pieces before anchors are taken, so no task holds more than
``CHUNK`` bytes of text besides its batch.

Rows: a null text is empty, and texts under ``LENGTH`` bytes stay whole; a null id counts as larger than
any other, other ids must cast to long, equal ids are not smaller than each other; rows that repeat an id are told apart by
a hash of their text, and equal rows get equal results.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import text_of
from netloom.operators.stages import settle

LENGTH = 50
GRAM = 8
WIDE = -(-(2 * LENGTH - GRAM) // 8) * 8  # of a segment, in whole words
GRAMS = (GRAM, 24, 40, LENGTH)  # for strings whose anchor is too common, the next longer one
BUCKET = 1 << 20
GROUP = 8  # buckets that travel together
SAMPLE = 1 << 25  # bytes of text that tell common anchors
HOT = 1 << 22  # bytes of segments of one anchor
LIMIT = 1 << 23  # bytes of segments compared at once
BLOCK = 1 << 15  # bytes hashed at a time, so that the steps stay in the cache
CHUNK = 1 << 21
FLUSH = 3 * CHUNK
NO_ID = 2**63 - 1
_ODD = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width``-byte string."""
    n = max(0, len(data) - width + 1)
    if n <= BLOCK:
        return _rolling(data, width) if n else np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        part = _rolling(data[at : at + BLOCK + width - 1], width)
        out[at : at + len(part)] = part
    return out


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """From hashes of halves."""
    h, span, out, have, left = data.astype(np.uint64) + np.uint64(1), 1, None, 0, width
    while True:
        power = np.uint64(pow(_ODD, span, 2**64))
        if left & 1:
            out = h if out is None else out[: len(h) - have] * power + h[have:]
            have += span
        left >>= 1
        if not left:
            break
        h = h[:-span] * power + h[span:]
        span *= 2
    out = out[: len(data) - width + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For every ``length``-byte string its smallest gram hash."""
    n = max(0, len(data) - length + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        key = _rolling(data[at : at + BLOCK + length - 1], gram)
        places, span = length - gram + 1, 1
        while span * 2 <= places:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        rest = places - span
        key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        out[at : at + len(key)] = key
    return out


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start and anchor of every segment; ``ends`` closes the pieces in ``data``.

    Neighbouring strings whose smallest gram has the same hash are one segment, wherever the gram stands in them, so a
    repeating text is not cut at every byte; a segment holds ``length - gram + 1`` strings at most.
    """
    key = anchors(data, length, gram)
    starts = np.concatenate([[0], ends[:-1]])
    allowed = np.zeros(len(key) + 1, np.int64)
    has = ends - starts >= length
    np.add.at(allowed, starts[has], 1)
    np.add.at(allowed, ends[has] - length + 1, -1)
    valid = np.flatnonzero(allowed.cumsum()[:-1] > 0)
    if not len(valid):
        return valid, valid, key[:0]
    own = key[valid]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)])
    heads = np.flatnonzero(new)
    new = (np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))) % (length - gram + 1) == 0
    first = valid[new]
    last = valid[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(valid) - 1]])]
    return first, last, own[new]


def recut(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of some ranges as segments of a longer gram: number of the range, first and last string start in ``data``, anchor."""
    ends = sizes.cumsum()
    low, high, key = segments(data[_ranges(first, sizes)], ends, LENGTH, gram)
    of = np.searchsorted(ends, low, side="right")
    moved = (first - (ends - sizes))[of]
    return of, low + moved, high + moved, key


def _ordered(direct: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of ``depth`` symbols or a few more; of equal strings one is sorted."""
    n, steps = len(words) - 1, range(0, depth, 7)
    if not len(direct):
        return direct
    keys = [words[np.minimum(direct + k, n)] for k in steps]
    h = np.zeros(len(direct), np.uint64)
    for key in keys:
        h = (h ^ key.view(np.uint64)) * np.uint64(_ODD)
        h ^= h >> np.uint64(29)
    by = np.argsort(h)
    new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(by)))
    for key in keys:
        own = key[by]
        if not ((own[1:] == own[:-1]) | new[1:]).all():  # different strings with one hash
            return direct[np.lexsort(keys[::-1])]
    # By the first seven symbols, then those still tied by the next ones.
    least = by[begin]
    order = np.argsort(keys[0][least])
    own = keys[0][least[order]]
    edge = np.concatenate([[True], own[1:] != own[:-1]])
    for key in keys[1:]:
        tied = ~edge
        tied[:-1] |= ~edge[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        group, own = edge.cumsum()[tied], key[least[order[tied]]]
        ranked = np.lexsort((own, group))
        order[tied], own = order[tied[ranked]], own[ranked]
        edge[tied[1:]] |= own[1:] != own[:-1]
    return direct[by[_ranges(begin[order], sizes[order])]]


def suffix_array(s: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``s`` (symbols 0 to 256) in order of at least ``depth`` symbols, in two stages.

    ``words[i]`` packs the seven symbols from ``i``, zeros beyond the end.
    """
    n, at = len(s), np.arange(len(s))
    after = np.append(s[1:], -1)
    turn = np.minimum.accumulate(np.where(s != after, at, n)[::-1])[::-1]  # where an equal run ends
    small = (s < after)[turn]
    direct = np.flatnonzero(small)
    direct = _ordered(direct, words, depth)
    bounds = np.searchsorted(s[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[s[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(257):
        parts = waiting[c]
        current = np.concatenate(parts) if parts else np.empty(0, np.int64)
        done = []
        while len(current):
            done.append(current)
            current = current[current > 0] - 1
            current = current[s[current] == c]
        own = np.concatenate([*done, direct[bounds[c] : bounds[c + 1]]]) if done else direct[bounds[c] : bounds[c + 1]]
        waiting[c] = []
        if not len(own):
            continue
        out.append(own)
        before = own[own > 0] - 1
        first = s[before]
        larger = first > c
        before, first = before[larger], first[larger]
        order = np.argsort(first, kind="stable")
        chars, cuts = np.unique(first[order], return_index=True)
        for x, part in zip(chars.tolist(), np.split(before[order], cuts[1:]), strict=False):
            waiting[x].append(part)
    return np.concatenate(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    ahead = np.concatenate([[0], sizes.cumsum()[:-1]])
    return np.repeat(starts - ahead, sizes) + np.arange(total)


def repeated(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (segment, from, to) of ``length``-byte strings that a segment of a smaller document holds.

    ``data`` holds the segments one after another; each has ``length`` bytes or more.
    """
    none = np.empty(0, np.int64)
    begin = np.concatenate([[0], sizes.cumsum()[:-1]])
    counts = sizes - length + 1
    string = _ranges(begin, counts)
    of = np.repeat(np.arange(len(sizes)), counts)
    h = rolling(data, length)[string]
    # Most hashes occur once; a small table of the others leaves few to be grouped.
    half = h.astype(np.uint32)
    ordered = np.sort(half)
    table, low = np.zeros(1 << 22, bool), np.uint32((1 << 22) - 1)
    table[ordered[1:][ordered[1:] == ordered[:-1]] & low] = True
    near = np.flatnonzero(table[half & low])
    if not len(near):
        return none, none, none
    order = near[np.argsort(h[near])]
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    heads = np.flatnonzero(new)
    own = docs[of[order]]
    shared = np.minimum.reduceat(own, heads) < np.maximum.reduceat(own, heads)
    shared = order[shared[np.cumsum(new) - 1]]
    if not len(shared):
        return none, none, none
    # The text of the suffix array: per segment, what its shared strings span, closed by a symbol below all.
    kept = np.unique(of[shared])
    low, high = np.full(len(sizes), len(data)), np.zeros(len(sizes), np.int64)
    np.minimum.at(low, of[shared], string[shared])
    np.maximum.at(high, of[shared], string[shared] + length)
    spans = high[kept] - low[kept]
    text = np.zeros(int(spans.sum()) + len(kept), np.int64)
    place = np.concatenate([[0], (spans + 1).cumsum()[:-1]])
    text[_ranges(place, spans)] = data[_ranges(low[kept], spans)].astype(np.int64) + 1
    moved = np.zeros(len(sizes), np.int64)
    moved[kept] = place - low[kept]
    source = np.full(len(text), -1)
    source[string[shared] + moved[of[shared]]] = shared
    padded = np.concatenate([text, np.zeros(7, np.int64)])
    words = np.zeros(len(text) + 1, np.int64)
    for k in range(7):
        words = (words << 9) | padded[k : k + len(text) + 1]
    sa = suffix_array(text, words, length)
    sa = sa[source[sa] >= 0]
    same = np.ones(len(sa) - 1, bool)
    for k in (*range(0, length - 6, 7), length - 7):
        w = words[sa + k]
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    own = docs[of[source[sa]]]
    least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(sa))))
    gone = np.sort(source[sa[own > least]])
    if not len(gone):
        return none, none, none
    new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (of[gone][1:] != of[gone][:-1])])
    first = gone[new]
    last = gone[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(gone) - 1]])]
    return of[first], string[first] - begin[of[first]], string[last] - begin[of[first]] + length


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(WIDE, np.uint8)])


def _rows(padded: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Segments as rows of equal width, zeros behind them."""
    rows = padded[first[:, None] + np.arange(WIDE)]
    rows[np.arange(WIDE) >= sizes[:, None]] = 0
    return rows


def _row_hashes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = sizes.astype(np.uint64)
    for k, word in enumerate(rows.view(np.uint64).T):
        h = (h ^ word) * np.uint64(pow(_ODD, k + 1, 2**64))
        h ^= h >> np.uint64(31)
    return h


def repeated_in_parts(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`repeated`, for any number of segments of a bucket.

    Beyond ``LIMIT`` bytes equal segments are compared once, and the strings of the others are dealt by the anchors of a longer gram.
    """
    if len(data) <= LIMIT:
        return repeated(data, sizes, docs)
    begin, padded = np.concatenate([[0], sizes.cumsum()[:-1]]), _padded(data)
    step = max(1, LIMIT // int(sizes.max()))
    blocks = [slice(at, at + step) for at in range(0, len(sizes), step)]
    h = np.concatenate([_row_hashes(_rows(padded, begin[b], sizes[b]), sizes[b]) for b in blocks])
    order = np.lexsort((docs, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    equal = [(sizes[x] == sizes[y]) & (_rows(padded, begin[x], sizes[x]) == _rows(padded, begin[y], sizes[y])).all(axis=1) for x, y in ((order[b], head[b]) for b in blocks)]
    equal = np.concatenate(equal) & (order != head)
    beaten = equal & (docs[order] > docs[head])
    gone, other, leader = order[beaten], order[equal & ~beaten], head[equal & ~beaten]
    alone = np.sort(order[~equal])
    del padded, h, order, new, head, equal, beaten

    if int(sizes[alone].sum()) <= LIMIT or level + 1 == len(GRAMS):
        which, low, high = repeated(data[_ranges(begin[alone], sizes[alone])], sizes[alone], docs[alone])
        which = alone[which]
    else:
        cuts = []
        for b in (alone[at : at + step] for at in range(0, len(alone), step)):
            of, first, last, key = recut(data, begin[b], sizes[b], GRAMS[level + 1])
            cuts.append((b[of], (first - begin[b][of]).astype(np.uint8), (last - first + LENGTH).astype(np.uint8), key))
        of, first, own, key = (np.concatenate(x) for x in zip(*cuts, strict=True))
        parts = -(-2 * int(own.sum(dtype=np.int64)) // LIMIT)
        part = ((key * np.uint64(_ODD) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        del cuts, key
        out = []
        for k in range(parts):
            at = np.flatnonzero(part == k)
            if len(at):
                size, start = own[at].astype(np.int64), first[at].astype(np.int64)
                hit, low, high = repeated_in_parts(data[_ranges(begin[of[at]] + start, size)], size, docs[of[at]], level + 1)
                out.append((of[at[hit]], low + start[hit], high + start[hit]))
        which, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(which, kind="stable")
    which, low, high = which[order], low[order], high[order]
    # What the leaders lose, their equals of the same document lose too.
    at, n = np.searchsorted(which, leader), np.searchsorted(which, leader, side="right")
    n -= at
    at, copy = _ranges(at, n), np.repeat(other, n)
    which = np.concatenate([which, copy, gone])
    low, high = np.concatenate([low, low[at], np.zeros_like(gone)]), np.concatenate([high, high[at], sizes[gone]])
    order = np.lexsort((low, which))
    return which[order], low[order], high[order]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.uint32(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload), 0, []
    for kind in kinds:
        size = int(np.frombuffer(raw, np.uint32, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 4))
        at += 4 + size
    return out


class Sender:
    """Collects the segments of a task's documents and emits them packed by group of buckets."""

    def __init__(self, buckets: int, hot: np.ndarray | None = None):
        self.buckets = buckets
        self.hot = np.empty(0, np.uint64) if hot is None else np.sort(hot)
        self.groups = -(-buckets // GROUP)
        self.pieces: list[tuple[int, int, int, bytes]] = []
        self.held = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.sent = 0

    def add(self, doc: int, mark: int, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        for at in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            if len(piece) >= LENGTH:
                self.pieces.append((doc, mark, at, piece))
                self.held += len(piece)
            if self.held >= CHUNK:
                yield from self.cut()

    def cut(self) -> Iterator[tuple[int, int, bytes]]:
        if self.pieces:
            data = np.frombuffer(b"".join(p[3] for p in self.pieces), np.uint8)
            ends = np.cumsum([len(p[3]) for p in self.pieces])
            first, last, key = segments(data, ends)
            if len(self.hot):
                common = self.hot[np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)] == key
                again = np.flatnonzero(common)
                _, *cut = recut(data, first[again], last[again] - first[again] + LENGTH, GRAMS[1])
                first, last, key = (np.concatenate([x[~common], y]) for x, y in zip((first, last, key), cut, strict=True))
            piece = np.searchsorted(ends, first, side="right")
            table = np.array([p[:3] for p in self.pieces], np.int64)
            starts = ends - np.array([len(p[3]) for p in self.pieces])
            sizes = last - first + LENGTH
            rows = _rows(_padded(data), first, sizes)
            bucket = (key * np.uint64(_ODD) >> np.uint64(32)) % np.uint64(self.buckets)
            self.parts.append((
                bucket.astype(np.int64), table[piece, 0], table[piece, 1], first - starts[piece] + table[piece, 2], sizes, rows
            ))
            self.sent += self.held
            self.pieces, self.held = [], 0
        if self.sent >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.parts:
            return
        bucket, doc, mark, pos, sizes, rows = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.sent = [], 0
        h = _row_hashes(rows, sizes)
        order = np.lexsort((doc, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        equal = (sizes[order] == sizes[head]) & (rows[order] == rows[head]).all(axis=1)
        beaten = np.zeros(len(doc), bool)
        beaten[order] = equal & (doc[order] > doc[head])
        # Equal segments of one text travel once, with the places of the others.
        again = equal & (order != head) & (doc[order] == doc[head]) & (mark[order] == mark[head])
        other, leader = order[again], head[again]
        held = beaten.copy()
        held[other] = True
        sent = np.flatnonzero(~held)
        sent = sent[np.lexsort((pos[sent], doc[sent], bucket[sent]))]
        place = np.zeros(len(doc), np.int64)
        place[sent] = np.arange(len(sent))
        ranked = np.lexsort((pos[other], place[leader]))
        other, leader = other[ranked], place[leader[ranked]]
        which, cuts = np.unique(bucket[sent] // GROUP, return_index=True)
        inside = np.arange(rows.shape[1])
        for b, start, own in zip(which.tolist(), cuts.tolist(), np.split(sent, cuts[1:]), strict=True):
            d, (low, high) = doc[own], np.searchsorted(leader, [start, start + len(own)])
            yield b, 0, _pack(
                np.concatenate([d[:1], np.diff(d)]), mark[own], pos[own], sizes[own].astype(np.uint8),
                (bucket[own] % GROUP).astype(np.uint8), rows[own][inside < sizes[own, None]],
                (leader[low:high] - start).astype(np.uint32), pos[other[low:high]],
            )
        gone = np.flatnonzero(beaten)
        home = doc[gone] % self.groups
        gone = gone[np.argsort(home, kind="stable")]
        which, cuts = np.unique(doc[gone] % self.groups, return_index=True)
        for b, own in zip(which.tolist(), np.split(gone, cuts[1:]), strict=False):
            yield b, 1, _pack(doc[own], mark[own], pos[own], pos[own] + sizes[own])


def _compare(t: pa.Table) -> pa.Table:
    """One group of buckets: the ranges that its segments lose, and those that tasks had settled."""
    out, kept = [], []
    for kind, payload in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
        if kind:
            out.append(_unpack(payload, "<i8", "<i8", "<i8", "<i8"))
        else:
            kept.append(_unpack(payload, "<i8", "<i8", "<i8", "u1", "u1", "u1", "<u4", "<i8"))
            kept[-1][0] = kept[-1][0].cumsum()
    for sub in range(GROUP if kept else 0):
        parts, before = [], 0
        for docs, marks, pos, sizes, bucket, data, leader, places in kept:  # sorted by bucket
            low, high = np.searchsorted(bucket, [sub, sub + 1])
            if low < high:
                begin, end = int(sizes[:low].sum(dtype=np.int64)), int(sizes[:high].sum(dtype=np.int64))
                first, last = np.searchsorted(leader, [low, high])
                parts.append((
                    docs[low:high], marks[low:high], pos[low:high], sizes[low:high], data[begin:end],
                    leader[first:last].astype(np.int64) + (before - low), places[first:last],
                ))
                before += high - low
        if parts:
            docs, marks, pos, sizes, data, leader, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            of, low, high = repeated_in_parts(data, sizes.astype(np.int64), docs)
            out.append([docs[of], marks[of], pos[of] + low, pos[of] + high])
            # The same ranges at the other places of an equal segment.
            first, n = np.searchsorted(leader, of), np.searchsorted(leader, of, side="right")
            n -= first
            at, hit = places[_ranges(first, n)], np.repeat(np.arange(len(of)), n)
            out.append([docs[of[hit]], marks[of[hit]], at + low[hit], at + high[hit]])
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return pa.table({"doc": columns[0], "mark": columns[1], "span": (columns[2] << 32) | columns[3]})


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, mark, text``: ``mark`` tells rows that repeat an id apart."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of(F.col("text")).alias("text"))
    twice = rows.groupBy(F.col("doc").alias("again")).count().where("count > 1").select("again")
    if twice.isEmpty():
        return rows.withColumn("mark", F.lit(0).cast("long"))
    joined = rows.join(twice, F.col("doc") == F.col("again"), "left")
    return joined.select("doc_id", "doc", "text", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("mark"))


def common_anchors(rows: DataFrame, size: int) -> np.ndarray:
    """Anchors whose segments hold more than ``HOT`` bytes of the whole table, by the weights in a sample of its rows.

    Their number is bounded by the size of all segments over ``HOT``.  ``size`` is that of all texts.
    """
    parts = -(-size // SAMPLE)

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            held, pieces = 0, []
            for last, text in zip((*[False] * (batch.num_rows - 1), True), batch.column(0), strict=True):
                raw = text.as_py()
                for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
                    pieces.append(raw[at : at + CHUNK + LENGTH - 1])
                    held += len(pieces[-1])
                    if held >= CHUNK or (last and at + CHUNK > len(raw) - LENGTH):
                        first, end, key = segments(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]))
                        found, of = np.unique(key, return_inverse=True)
                        weight = np.bincount(of, end - first + LENGTH, len(found)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(weight)], ["anchor", "weight"])
                        held, pieces = 0, []

    drawn = rows.where(F.pmod(F.xxhash64("doc", "mark"), F.lit(parts)) == 0) if parts > 1 else rows
    weights = drawn.select(F.col("text").cast("binary")).mapInArrow(weigh, "anchor long, weight long")
    total = weights.groupBy("anchor").agg(F.sum("weight").alias("weight")).where(F.col("weight") * parts > HOT)
    return np.array([r.anchor for r in total.select("anchor").collect()], np.int64).view(np.uint64)


def removed_ranges(rows: DataFrame) -> DataFrame:
    """``doc, mark, span``: ranges to remove (``from << 32 | to``), overlaps included."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET))
    hot = common_anchors(rows, size) if size > HOT else None

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(buckets, hot)

        def batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["bucket", "kind", "payload"])

        for part in it:
            for doc, mark, text in zip(*part.columns, strict=True):
                found = list(sender.add(doc.as_py(), mark.as_py(), text.as_py()))
                if found:
                    yield batch(found)
        found = [*sender.cut(), *sender.flush()]
        if found:
            yield batch(found)

    packs = rows.select("doc", "mark", F.col("text").cast("binary")).mapInArrow(send, "bucket long, kind int, payload binary")
    return packs.groupBy("bucket").applyInArrow(_compare, "doc long, mark long, span long")


def cut_text(text: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """What is left of ``text`` without the sorted ranges, the bytes removed and the number of maximal runs."""
    kept, runs, at, end = [], 0, 0, -1
    for span in spans:
        low, high = span >> 32, span & 0xFFFFFFFF
        if low > end:
            runs += 1
            kept.append(text[at:low])
        end = max(end, high)
        at = end
    kept.append(text[at:])
    rest = b"".join(kept)
    return rest, len(text) - len(rest), runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row."""
    rows = _identified(docs)
    # Written, so that the packed segments are deleted before the texts are shuffled.
    spans = settle(removed_ranges(rows), "repeat-spans").groupBy("doc", "mark").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    spans = spans.withColumnsRenamed({"doc": "of", "mark": "of_mark"})
    joined = rows.join(spans, (F.col("doc") == F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, found = [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                sizes.append(len(raw))
                found.append(cut_text(raw, own.as_py() or []))
            kept, gone, runs = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", F.col("text").cast("binary"), "spans").mapInArrow(
        cut, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def query(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
