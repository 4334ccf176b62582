"""Cheapest repair of conversations by a dynamic programme with square-root checkpoints.

Rows of a conversation are kept (0), given another role (2) or deleted (3), and empty rows are inserted (2), so that the
role initials read ``(s?(ua)+)?``; a truncated row that stays costs 1 more, blank and repeated rows must go.
Four states describe what has been read: nothing, a system row, a user row, an assistant row.  The
backward pass leaves, for every row, the cheapest cost to the end from each state, but stores these vectors
only at every ``sqrt(n)``-th row; walking forward, each stretch is recomputed from the checkpoint at its end, and
the ASCII-least edit is taken among those whose cost is tight.

Equal rows of one turn are combined before the shuffle, so a row repeated without end moves once.  Rows are then
sorted by range over (conversation, turn, role, text), which cuts a long conversation over many tasks.  A
conversation that lies within one task is repaired there.  Those at a task's ends may go on in the next one; their *pieces*
are summed up in parallel as 4 x 4 tables of least costs, the tables give the vector at every piece's end, and with it
the pieces are walked in order.  That last walk is one stream per conversation, because the hash of the repaired text is
sequential; it holds one piece at a time.

Rows: a null conversation id is a conversation of its own; null turns come first; of equal turns the order is by role,
then by MD5 of the text; null roles and texts read as one space; a role is recognised by its first letter.
Original conversations without rows after the damage have zeros, an empty audit and the hash of the empty
text.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.streams import runs
from netloom.operators.stages import settle

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
END = (0, 4, 2, 0)  # a user row needs an assistant row after it, a system row needs both
FAR = 1 << 50
REROLED = (USER, USER, ASSISTANT, USER)  # the only role that may follow each state, but for a system row at the start
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
_LEGAL = {b"su", b"ua", b"au"}
_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Vector = tuple[int, int, int, int]


def following(state: int, initial: bytes) -> int | None:
    """The state after keeping a row, or None where the row cannot stay in its role."""
    if initial == b"s":
        return SYSTEM if state == NOTHING else None
    if initial == b"u":
        return None if state == USER else USER
    if initial == b"a":
        return ASSISTANT if state == USER else None
    return None


def backward(initial: bytes, extra: int, after: Vector) -> Vector:
    """Least costs to the end before a row that may stay, from those behind it."""
    v0, vs, vu, va = after
    kept = 2 + extra
    n0, ns, nu, na = min(3 + v0, kept + vu), min(3 + vs, kept + vu), min(3 + vu, kept + va), min(3 + va, kept + vu)
    if initial == b"u":
        n0, ns, na = min(n0, extra + vu), min(ns, extra + vu), min(na, extra + vu)
    elif initial == b"a":
        nu = min(nu, extra + va)
    elif initial == b"s":
        n0 = min(n0, extra + vs)
    u, a = min(nu, 2 + na), min(na, 2 + nu)
    return min(n0, 2 + u), min(ns, 2 + u), u, a


class Walk:
    """One conversation, repaired piece by piece in order."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.hash, self.lines = NOTHING, 0, [], hashlib.sha256(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: bytes | None = None
        self.low = self.high = self.turn = None
        self.turns = 0

    def _line(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role + b":" + text)
        self.lines += 1

    def piece(self, rows: list[tuple], end: Vector) -> None:
        """Rows ``(turn, role, text, copies, again)`` in order; ``end`` holds the least costs behind them."""
        live: list[tuple[bytes, int, bytes, bytes]] = []
        gone = [0]  # rows to delete before each row that may stay, and behind the last one
        for turn, role, text, copies, again in rows:
            initial = role[:1]
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.high = self.turn = turn
                self.turns += 1
            if self.before is not None:
                self.illegal += self.before + initial not in _LEGAL
            self.illegal += copies - 1
            self.before = initial
            said = text.strip()
            if not said:
                self.blank += copies
                gone[-1] += copies
            elif again:
                self.duplicate += copies
                gone[-1] += copies
            else:
                cut = said[-1:] not in b".!?"
                self.truncated += cut
                self.duplicate += copies - 1
                live.append((initial, int(cut), role, text))
                gone.append(copies - 1)
        self._edit(live, gone, end)

    def _edit(self, live: list[tuple[bytes, int, bytes, bytes]], gone: list[int], end: Vector) -> None:
        n = len(live)
        step = max(1, isqrt(n))
        stored, vector = {n: end}, end
        for k in range(n - 1, -1, -1):
            vector = backward(live[k][0], live[k][1], vector)
            if k % step == 0:
                stored[k] = vector
        self._drop(gone[0])
        for start in range(0, n, step):
            stop = min(n, start + step)
            block = [stored[stop]]
            for k in range(stop - 1, start - 1, -1):
                block.append(backward(live[k][0], live[k][1], block[-1]))
            for k in range(start, stop):
                self._row(live[k], block[stop - k], block[stop - k - 1])
                self._drop(gone[k + 1])

    def _drop(self, rows: int) -> None:
        if rows:
            self.audit.append("D" * rows)
            self.cost += 3 * rows

    def _insert(self) -> None:
        self.state = REROLED[self.state]
        self.audit.append("I")
        self.cost += 2
        self._line(NAMES[self.state], b"")

    def _row(self, row: tuple[bytes, int, bytes, bytes], own: Vector, after: Vector) -> None:
        initial, extra, role, text = row
        while True:
            best, new = own[self.state], REROLED[self.state]
            if 3 + after[self.state] == best:
                self._drop(1)
                return
            if 2 + own[new] == best:
                self._insert()
                continue
            kept = following(self.state, initial)
            if kept is not None and extra + after[kept] == best:
                self.audit.append("K")
                self.cost += extra
                self._line(role, text)
                self.state = kept
            else:
                self.audit.append("R")
                self.cost += 2 + extra
                self._line(NAMES[new], text)
                self.state = new
            return

    def result(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (
            gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()
        )


def repaired(rows: Iterable[tuple]) -> tuple:
    """A whole conversation: its rows ``(turn, role, text, copies)`` in order."""
    seen, marked = set(), []
    for turn, role, text, copies in rows:
        if copies:
            marked.append((turn, role, text, copies, (role, text) in seen))
            seen.add((role, text))
    walk = Walk()
    walk.piece(marked, END)
    return walk.result()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: different rows after the damage; dropped ones have no copies."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), hit.alias("hit"))
    blank, role, text = F.lit(""), F.col("role"), F.col("text")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("hit") == 0, blank).when(F.col("hit") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("hit") < 2, blank).when(F.col("hit") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of :func:`damaged`."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role"), or_space("text"), F.lit(1).alias("copies"))


def _first_pass(rows: DataFrame) -> DataFrame:
    """Conversations within one task repaired (``piece`` null), and the rows of those at a task's ends with their piece."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "piece", "seq", "turn", "role", "text", "copies", *[f.split()[0] for f in _FACTS.split(", ")]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seq, number, held, out, id_type = TaskContext.get().partitionId(), 0, 0, [], [], None
        current = None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *kinds], strict=True)], names)

        def open_row(row: tuple) -> tuple:
            return (row[0], piece, row[5], *row[1:5], *[None] * 8)

        for batch in it:
            id_type = batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not number or row[0] != current:
                    if number > 1:
                        out.append((current, None, None, None, None, None, None, *repaired(x[1:5] for x in held)))
                    current, held, number = row[0], [], number + 1
                seq += 1
                row = (*row, seq)
                if number == 1:
                    out.append(open_row(row))
                else:
                    held.append(row)
                if len(out) >= 2000:
                    yield emit()
                    out = []
        out += [open_row(row) for row in held]
        if out:
            yield emit()

    return rows.mapInArrow(batches, f"conv_id {conv}, piece int, seq long, turn long, role binary, text binary, copies long, {_FACTS}")


def _costs(rows: DataFrame) -> DataFrame:
    """``conv_id, piece, costs``: least costs from each state before a piece to each state behind it."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(it):
            ends = [tuple(0 if s == e else FAR for s in range(4)) for e in range(4)]
            for _, role, text, copies, again in reversed(batch[2]):
                said = text.strip()
                if said and not again and copies:
                    extra = int(said[-1:] not in b".!?")
                    ends = [backward(role[:1], extra, v) for v in ends]
            flat = [ends[e][s] for s in range(4) for e in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch[0]], batch[3]), pa.array([batch[1]], pa.int32()), pa.array([flat], pa.list_(pa.int64()))], ["conv_id", "piece", "costs"]
            )

    flags = rows.select("open", "piece", "seq", "conv_id", "turn", "role", "text", "copies", "again")
    return flags.repartition("open", "piece").sortWithinPartitions("open", "piece", "seq").mapInArrow(
        batches, f"conv_id {conv}, piece int, costs array<bigint>"
    )


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, piece, rows, type of the id, remaining columns of the first row)`` from rows sorted by ``open, piece, seq``."""
    for table in runs(it, 2):
        own = list(zip(*(table.column(k).to_pylist() for k in range(4, 9)), strict=True))
        rest = [table.column(k)[0].as_py() for k in range(9, table.num_columns)]
        yield table.column(3)[0].as_py(), table.column(1)[0].as_py(), own, table.column(3).type, rest


def _ends(costs: DataFrame) -> DataFrame:
    """``of, of_piece, ends``: the least costs to the end behind every piece.  A conversation has a row per task at most."""
    conv = costs.schema["conv_id"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("piece").to_pylist(), table.column("costs").to_pylist(), strict=True))
        vector, out = list(END), []
        for piece, flat in reversed(rows):
            out.append((piece, vector))
            vector = [min(flat[4 * s + e] + vector[e] for e in range(4)) for s in range(4)]
        ids = pa.array([table.column("conv_id")[0].as_py()] * len(out), table.column("conv_id").type)
        return pa.table({"of": ids, "of_piece": pa.array([p for p, _ in out], pa.int32()), "ends": pa.array([v for _, v in out], pa.list_(pa.int64()))})

    return costs.groupBy("conv_id").applyInArrow(solve, f"of {conv}, of_piece int, ends array<bigint>")


def _walked(rows: DataFrame) -> DataFrame:
    """The facts of conversations whose pieces follow each other, ``ends`` attached to every row."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, current = None, None

        def done() -> pa.RecordBatch:
            facts = [pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in walk.result()]
            return pa.RecordBatch.from_arrays([pa.array([current], id_type), *facts], ["conv_id", *[f.split()[0] for f in _FACTS.split(", ")]])

        for conv_id, _, own, kind, (ends,) in _pieces(it):
            if walk is None or conv_id != current:
                if walk is not None:
                    yield done()
                walk, current, id_type = Walk(), conv_id, kind
            walk.piece([r for r in own if r[3]], tuple(ends))
        if walk is not None:
            yield done()

    columns = rows.select("open", "piece", "seq", "conv_id", "turn", "role", "text", "copies", "again", "ends")
    return columns.repartition("open").sortWithinPartitions("open", "piece", "seq").mapInArrow(batches, f"conv_id {conv}, {_FACTS}")


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Faults, cost, edits and hash of the repaired text per conversation of ``rows`` (see :func:`damaged`).

    ``parts`` is the number of ranges the rows are sorted into (the session's shuffle partitions by default).
    """
    text = F.col("text").cast("binary")
    different = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.md5(text)]
    spread = different.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    first = settle(_first_pass(spread.select("conv_id", "turn", F.col("role").cast("binary"), text, "copies")), "repair-first")
    facts = [f.split()[0] for f in _FACTS.split(", ")]
    whole = first.where("piece IS NULL").select("conv_id", *facts)

    # The conversation as a key without nulls; ids are equal exactly where these are.
    known = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    cut = first.where("piece IS NOT NULL").withColumn("open", known).withColumn("said", F.md5("text"))
    place = F.struct("piece", "seq")
    earliest = cut.where("copies > 0").groupBy(F.col("open").alias("o"), F.col("role").alias("r"), F.col("said").alias("t")).agg(F.min(place).alias("earliest"))
    same = (F.col("open") == F.col("o")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("t"))
    again = F.coalesce(place > F.col("earliest"), F.lit(False)).alias("again")
    marked = settle(
        cut.join(earliest, same, "left").select("open", "piece", "seq", "conv_id", "turn", "role", "text", "copies", again), "repair-cut"
    )
    ends = _ends(_costs(marked))
    behind = marked.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("of_piece")))
    return whole.unionByName(_walked(behind).select("conv_id", *facts))


def query(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
