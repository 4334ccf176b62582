"""Greedy anchored runs over ordered rows.

Flow assembly and alert dedup are the same problem: walk one key's rows in time
order, open a run at its first row, and let a later row open a new run when

* it follows the previous row by at least ``gap_us``, or
* it is at least ``limit_us`` younger than the first row (the *anchor*) of the open run, or
* the previous row closed the run (a closing row that is itself an anchor does not).

Most keys are small: their rows go to one task by key and one sorted window pass does it
all.  A key with more than ``hot_rows`` rows (one may hold a third of the table) is never
sorted in one task: its rows are shuffled by ``(key, time slice)``, and everything that
looks across a slice border (previous row, open session, open run, whether the run was
just closed) is carried by one summary row per slice, scanned per key, and joined back.
The gap and closing rules need nothing else: inside a session each row either resets the
"just closed" bit or toggles it.

The age rule is a chain (each anchor depends on the one before) and only matters for
rows at least ``limit_us`` younger than their session's first row.  Those rows alone go
through pandas, slice by slice: a slice is first reduced to a small step function from
"anchor open on entry" to "anchor open on exit", the step functions are folded per
session, and the slice is then cut knowing its entry state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys above this many rows are cut into time slices.
HOT_ROWS = 5_000_000

_CLOSED = np.iinfo(np.int64).min
_ALWAYS = np.iinfo(np.int64).max


def anchor_runs(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    rid: str,
    *,
    gap_us: int,
    slice_us: int,
    limit_us: int | None = None,
    closes: Column | None = None,
    tag: str | None = None,
    tracks: dict[str, Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add the run of every row; rows are ordered by ``(us, rid)``, ``rid`` unique.

    Added columns: ``anchor_us, anchor_id`` (and ``anchor_tag``: the anchor row's value
    of ``tag``), ``is_anchor``, ``is_closing`` (with ``closes``), ``session_us`` (first
    row after the last gap), ``prev_us``/``next_us`` (neighbours in the key) and, for
    each ``tracks`` entry ``name -> condition``, ``prev_name`` (``struct<us,id>`` of
    the latest earlier row where that condition holds).  Key columns must not be NULL.
    ``hot_rows=None`` slices every key and spares the count of rows per key.
    """
    rules = (keys, us, rid, gap_us, limit_us, closes, tag, tracks or {})
    if hot_rows is None:
        return _runs(df, slice_us, *rules)
    hot = _hot_keys(df, keys, hot_rows)
    if hot is None:
        return _runs(df, slice_us, *rules)
    if not hot:
        return _runs(df, None, *rules)
    hot = df.sparkSession.createDataFrame(hot, df.select(*keys).schema)
    cold = _runs(df.join(F.broadcast(hot), [*keys], "left_anti"), None, *rules)
    return cold.unionByName(_runs(df.join(F.broadcast(hot), [*keys], "left_semi"), slice_us, *rules))


def _hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int, at_most: int = 10_000) -> list | None:
    """Keys above the row limit; None when they are too many to list.

    A table within the limit cannot hold one, and its size comes from file footers.  Else
    the count reads only the key columns and is combined before the shuffle.
    """
    if df.count() <= hot_rows:
        return []
    hot = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(*keys)
    rows = hot.limit(at_most + 1).collect()
    return None if len(rows) > at_most else rows


def _runs(df, slice_us, keys, us, rid, gap_us, limit_us, closes, tag, tracks) -> DataFrame:
    part = list(keys)
    if slice_us is not None:
        part.append("_slice")
        df = df.withColumn("_slice", F.coalesce(F.expr(f"`{us}` div {int(slice_us)}"), F.lit(0)))
    # One explicit exchange; what the windows derive is computed above it and never shuffled.
    rows = df.repartition(*part)
    if closes is not None:
        rows = rows.withColumn("_closes", closes)
        closes = "_closes"
    if slice_us is None:
        rows = _whole_keys(rows, keys, us, rid, gap_us, closes, tag, tracks)
    else:
        columns = [c for c in df.columns if c != "_slice"]
        local = _within_slices(rows, keys, us, rid, gap_us, closes, tag, tracks)
        carry = _between_slices(local, keys, us, rid, gap_us, closes, tracks)
        rows = _stitch(local, carry, columns, keys, closes, tag, tracks)
    if limit_us is not None:
        age = F.col(us) - F.col("session_us")
        tail = _cut_by_age(rows.where(age >= limit_us), part, keys, us, rid, limit_us, closes, tag)
        rows = rows.where(age < limit_us).drop("_slice").unionByName(tail)
    return rows.drop("_slice", "_closes")


def _whole_keys(df, keys, us, rid, gap_us, closes, tag, tracks) -> DataFrame:
    """Gap and closing rules where one task holds the whole key."""
    w = Window.partitionBy(*keys).orderBy(us, rid)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    here = _row_struct(us, rid, None)
    out = df.withColumns({"prev_us": F.lag(us).over(w), "next_us": F.lead(us).over(w), "_rn": F.row_number().over(w)})
    out = out.withColumn("_gap", F.coalesce(F.col(us) - F.col("prev_us") >= F.lit(gap_us), F.lit(True)))
    last = {"session_us": F.last(F.when(F.col("_gap"), F.col(us)), ignorenulls=True).over(upto)}
    for name, flag in tracks.items():
        last[f"prev_{name}"] = F.last(F.when(flag, here), ignorenulls=True).over(before)
    anchor = F.col("_gap")
    if closes:
        # Rows since the last one that did not close and was no session start: an odd
        # number of closing rows in between leaves the run just closed.
        resets = F.when(~F.col(closes) | F.col("_gap"), F.col("_rn"))
        last["_reset"] = F.last(resets, ignorenulls=True).over(before)
        anchor = anchor | ((F.col("_rn") - 1 - F.col("_reset")) % 2 == 1)
    out = out.withColumns(last).withColumn("is_anchor", anchor)
    run = F.last(F.when(F.col("is_anchor"), _row_struct(us, rid, tag)), ignorenulls=True).over(upto)
    out = out.withColumn("_run", run).withColumns({"anchor_us": F.col("_run.us"), "anchor_id": F.col("_run.id")})
    if tag:
        out = out.withColumn("anchor_tag", F.col("_run.tag"))
    if closes:
        out = out.withColumn("is_closing", F.col(closes) & ~F.col("is_anchor"))
    return out.drop("_rn", "_gap", "_run", "_reset")


def _row_struct(us: str, rid: str, tag: str | None) -> Column:
    fields = [F.col(us).alias("us"), F.col(rid).alias("id")]
    if tag:
        fields.append(F.col(tag).alias("tag"))
    return F.struct(*fields)


def _within_slices(df, keys, us, rid, gap_us, closes, tag, tracks) -> DataFrame:
    """Everything a row can know from its own slice (columns prefixed ``_``)."""
    w = Window.partitionBy(*keys, "_slice").orderBy(us, rid)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    me = _row_struct(us, rid, tag)

    out = df.withColumns(
        {"_lag": F.lag(us).over(w), "_lead": F.lead(us).over(w), "_rn": F.row_number().over(w)}
    )
    inner = F.col("_lag").isNotNull()
    gap_cut = inner & (F.col(us) - F.col("_lag") >= F.lit(gap_us))
    out = out.withColumn("_gap", gap_cut)
    aggs = {
        "_first": F.first(me).over(upto),
        "_sess": F.last(F.when(F.col("_gap"), F.col(us)), ignorenulls=True).over(upto),
    }
    if closes:
        resets = inner & (~F.col(closes) | F.col("_gap"))
        out = out.withColumn(
            "_reset_rn", F.last(F.when(resets, F.col("_rn")), ignorenulls=True).over(before)
        )
        # "Just closed" bit before this row.  It is exact once the slice holds a reset;
        # until then it is relative to the bit left by the slice's first row.
        out = out.withColumns(
            {
                "_known": F.col("_reset_rn").isNotNull(),
                "_bit": (F.col("_rn") - 1 - F.coalesce("_reset_rn", F.lit(1))) % 2 == 1,
            }
        )
        flipped = F.when(F.col("_known"), F.col("_bit")).otherwise(~F.col("_bit"))
        aggs["_run0"] = F.last(
            F.when(inner & (F.col("_gap") | F.col("_bit")), me), ignorenulls=True
        ).over(upto)
        aggs["_run1"] = F.last(
            F.when(inner & (F.col("_gap") | flipped), me), ignorenulls=True
        ).over(upto)
        aggs["_first_closes"] = F.first(closes).over(upto)
    else:
        aggs["_run0"] = F.last(F.when(F.col("_gap"), me), ignorenulls=True).over(upto)
    here = _row_struct(us, rid, None)
    for name, flag in tracks.items():
        aggs[f"_track_{name}"] = F.last(F.when(flag, here), ignorenulls=True).over(before)
    return out.withColumns(aggs)


def _between_slices(local, keys, us, rid, gap_us, closes, tracks) -> DataFrame:
    """One row per (key, slice): the state in which each slice is entered."""
    w = Window.partitionBy(*keys).orderBy("_slice")
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    cols = [*keys, "_slice", "_first", "_sess", "_run0", F.col(us).alias("_last_us")]
    if closes:
        resets = F.col("_lag").isNotNull() & (~F.col(closes) | F.col("_gap"))
        cols += [
            "_run1",
            "_first_closes",
            (F.col("_known") | resets).alias("_end_known"),
            F.when(F.col("_rn") == 1, False).when(resets, False).otherwise(~F.col("_bit")).alias("_end_bit"),
        ]
    here = _row_struct(us, rid, None)
    for name, flag in tracks.items():
        track = f"_track_{name}"
        cols.append(F.when(flag, here).otherwise(F.col(track)).alias(track))
    # The last row of a slice already holds every running value.
    s = local.where(F.col("_lead").isNull()).select(*cols)

    s = s.withColumns(
        {"_prev_last": F.lag("_last_us").over(w), "_next_first": F.lead("_first.us").over(w)}
    )
    s = s.withColumn(
        "_new1",
        F.col("_prev_last").isNull() | (F.col("_first.us") - F.col("_prev_last") >= F.lit(gap_us)),
    )
    sess_end = F.coalesce("_sess", F.when(F.col("_new1"), F.col("_first.us")))
    carried = {"_sess_in": F.last(sess_end, ignorenulls=True).over(before)}
    for name in tracks:
        carried[f"_track_in_{name}"] = F.last(f"_track_{name}", ignorenulls=True).over(before)
    if closes:
        fixed = F.col("_end_known") | ~F.col("_first_closes") | F.col("_new1")
        # A slice without any reset flips the incoming bit once per row.
        s = s.withColumns({"_fixed": fixed, "_flip": F.when(fixed, 0).otherwise(F.when(F.col("_end_bit"), 0).otherwise(1))})
        s = s.withColumn("_flips", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        base = F.when(F.col("_fixed"), F.col("_flips") + F.col("_end_bit").cast("int"))
        s = s.withColumns(
            {
                "_base": F.last(base, ignorenulls=True).over(before),
                "_flips_in": F.lag("_flips", 1, 0).over(w),
                **carried,
            }
        )
        bit_in = F.coalesce((F.col("_base") + F.col("_flips_in")) % 2 == 1, F.lit(False))
        s = s.withColumn("_anchor1", F.col("_new1") | bit_in)
        s = s.withColumn("_bit1", F.col("_first_closes") & ~F.col("_anchor1"))
        run = F.when(F.col("_bit1"), F.col("_run1")).otherwise(F.col("_run0"))
    else:
        s = s.withColumns({"_anchor1": F.col("_new1"), **carried})
        run = F.col("_run0")
    run_end = F.coalesce(run, F.when(F.col("_anchor1"), F.col("_first")))
    s = s.withColumn("_run_in", F.last(run_end, ignorenulls=True).over(before))
    keep = ["_new1", "_sess_in", "_anchor1", "_run_in", "_prev_last", "_next_first"]
    if closes:
        keep.append("_bit1")
    keep += [f"_track_in_{name}" for name in tracks]
    return s.select(*keys, "_slice", *keep)


def _stitch(local, carry, columns, keys, closes, tag, tracks) -> DataFrame:
    rows = local.join(carry, [*keys, "_slice"])
    first = F.col("_lag").isNull()
    if closes:
        bit = F.when(F.col("_known") | ~F.col("_bit1"), F.col("_bit")).otherwise(~F.col("_bit"))
        anchor = F.when(first, F.col("_anchor1")).otherwise(F.col("_gap") | bit)
        run = F.when(F.col("_bit1"), F.col("_run1")).otherwise(F.col("_run0"))
    else:
        anchor = F.when(first, F.col("_anchor1")).otherwise(F.col("_gap"))
        run = F.col("_run0")
    run = F.coalesce(run, F.when(F.col("_anchor1"), F.col("_first")), F.col("_run_in"))
    session = F.coalesce("_sess", F.when(F.col("_new1"), F.col("_first.us")), F.col("_sess_in"))
    rows = rows.withColumns({"_run": run, "is_anchor": anchor, "session_us": session})
    out = [
        *(F.col(f"`{c}`") for c in columns),
        "_slice",
        "session_us",
        F.col("_run.us").alias("anchor_us"),
        F.col("_run.id").alias("anchor_id"),
        "is_anchor",
        F.coalesce("_lag", "_prev_last").alias("prev_us"),
        F.coalesce("_lead", "_next_first").alias("next_us"),
    ]
    if tag:
        out.append(F.col("_run.tag").alias("anchor_tag"))
    if closes:
        out += [closes, (F.col(closes) & ~F.col("is_anchor")).alias("is_closing")]
    for name in tracks:
        out.append(F.coalesce(f"_track_{name}", f"_track_in_{name}").alias(f"prev_{name}"))
    return rows.select(*out)


# -- the age rule -----------------------------------------------------------------------


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup a sorted stream so that no (key, slice) group is split; ``_seq`` = 1 starts one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_seq").to_numpy() == 1)
        if len(starts) == 0:
            held.append(batch)
            continue
        cut = int(starts[-1])
        ready = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
        if ready:
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


class _Chains:
    """Successor of every row of several (key, slice, session) groups, taken as an anchor."""

    def __init__(self, table: pa.Table, us: str, closes: str | None, limit: int) -> None:
        self.limit = limit
        self.t = t = _ints(table, us)
        n = len(t)
        session = _ints(table, "session_us")
        first = _ints(table, "_seq") == 1
        first[1:] |= session[1:] != session[:-1]
        self.lo = np.flatnonzero(first)
        self.hi = np.append(self.lo[1:], n)
        self.group = np.cumsum(first) - 1
        self.c = c = _bools(table, closes) if closes else np.zeros(n, bool)
        end = self.hi[self.group]
        # One clock for all groups, so that one search serves them: only steps shorter than
        # the limit matter, and groups lie more than the limit apart.
        step = np.minimum(np.diff(t, prepend=t[0]), limit)
        step[self.lo] = limit + 1
        self.at = np.cumsum(step)
        too_old = np.searchsorted(self.at, self.at + limit, side="left")
        closing = np.minimum.accumulate(np.where(c, np.arange(n), n)[::-1])[::-1]
        self.first_closing = np.minimum(closing[self.lo], self.hi)
        after = np.minimum(np.append(closing[1:], n), end)
        self.next = np.minimum(too_old, np.minimum(after + 1, end))
        self.end = end
        #: whether a run anchored here is closed exactly by the group's last row
        self.ends_closed = (after == end - 1) & (too_old >= end)

    def enter(self, open_us: np.ndarray) -> np.ndarray:
        """First anchor of each group, given the anchor open on entry (``hi`` = none)."""
        closed = open_us == _CLOSED
        ago = np.where(closed, 0, self.t[self.lo] - open_us)
        found = np.searchsorted(self.at, self.at[self.lo] - ago + self.limit, side="left")
        found = np.minimum(np.maximum(found, self.lo), self.top())
        return np.where(closed, self.lo, found)

    def top(self) -> np.ndarray:
        """The last possible first anchor of each group."""
        return np.minimum(self.first_closing + 1, self.hi)

    def last(self) -> np.ndarray:
        """The last anchor of the group reached from each row."""
        hop = np.where(self.next < self.end, self.next, np.arange(len(self.t)))
        while True:
            further = hop[hop]
            if np.array_equal(further, hop):
                return hop
            hop = further

    def anchors(self, entry: np.ndarray) -> np.ndarray:
        """All rows reached from the entries."""
        mark = np.zeros(len(self.t), bool)
        at = entry[entry < self.hi]
        while len(at):  # one round per run, all groups at once
            mark[at] = True
            end = self.end[at]
            at = self.next[at]
            at = at[at < end]
        return mark


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _bools(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(bool, copy=False)


def _cut_by_age(tail, part, keys, us, rid, limit, closes, tag) -> DataFrame:
    order = Window.partitionBy(*part).orderBy(us, rid)
    sliced = "_slice" in part
    if not tag:
        tail = tail.withColumn("anchor_tag", F.lit(0))
    tag_col = tag or "anchor_tag"
    # The age rule starts at the first row past the limit; the state there is already known.
    tail = tail.withColumn("_entry", F.col("prev_us") - F.col("session_us") < F.lit(limit))
    key_fields = [tail.schema[k] for k in keys]

    def longs(*names: str) -> list[T.StructField]:
        return [T.StructField(n, T.LongType()) for n in names]

    step_schema = T.StructType(
        key_fields + longs("_slice", "session_us", "upto", "out_us", "out_id", "out_tag", "same")
    )
    state_schema = T.StructType(key_fields + longs("_slice", "session_us", "in_us", "in_id", "in_tag"))
    width = len(key_fields)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per group: rows ``upto -> out``, ascending; the first with open_us <= upto holds."""
        for table in _whole_groups(batches):
            ch = _Chains(table, us, closes, limit)
            ids, tags = _ints(table, rid), _ints(table, tag_col)
            known = _bools(table, "_entry")[ch.lo]
            anchor_us = _ints(table, "anchor_us")[ch.lo]
            open_us = np.where(_bools(table, "is_anchor")[ch.lo], _CLOSED, anchor_us)
            fixed, top = ch.enter(open_us), ch.top()
            count = np.where(known, 1, top - ch.lo + 1)
            g = np.repeat(np.arange(len(ch.lo)), count)
            nth = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
            entry = np.where(known[g], fixed[g], ch.lo[g] + nth)
            inside = entry < ch.hi[g]
            row = np.minimum(entry, ch.hi[g] - 1)
            final = known[g] | (entry == top[g])
            upto = np.where(final, _ALWAYS, ch.t[row] - limit)
            exit_row = ch.last()[row]
            closed = np.where(inside, ch.ends_closed[exit_row], ch.c[ch.hi[g] - 1])
            same = ~inside & ~closed
            # Where the open anchor is known, "unchanged" is a constant like any other.
            stays = same & known[g]
            first = ch.lo[g]
            out_us = np.where(closed, _CLOSED, np.where(stays, anchor_us[g], ch.t[exit_row]))
            out_id = np.where(stays, _ints(table, "anchor_id")[first], ids[exit_row])
            out_tag = np.where(stays, _ints(table, "anchor_tag")[first], tags[exit_row])
            same &= ~known[g]
            exit_key = np.where(same, -1, np.where(closed, -2, exit_row))
            keep = np.append((exit_key[1:] != exit_key[:-1]) | (g[1:] != g[:-1]), True)
            where = pa.array(first[keep])
            columns = [table.column(k).take(where).combine_chunks() for k in (*keys, "_slice", "session_us")]
            columns += [pa.array(a[keep].astype(np.int64)) for a in (upto, out_us, out_id, out_tag, same)]
            yield from pa.table(columns, names=step_schema.names).to_batches()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk the slices of each session; memory does not grow with their number."""
        session, slice_no, state, done = None, None, (_CLOSED, 0, 0), False
        for pdf in batches:
            entered = []
            for row in pdf.itertuples(index=False, name=None):
                key, (at, start, upto, *out, same) = row[:width], row[width:]
                if (*key, start) != session:
                    session, slice_no, state = (*key, start), None, (_CLOSED, 0, 0)
                if at != slice_no:
                    slice_no, done = at, False
                    entered.append((*key, at, start, *state))
                if not done and state[0] <= upto:
                    done = True
                    state = state if same else tuple(out)
            yield pd.DataFrame(entered, columns=state_schema.names)

    out_schema = T.StructType([f for f in tail.schema if f.name not in ("_slice", "_entry")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            ch = _Chains(table, us, closes, limit)
            known = _bools(table, "_entry")[ch.lo]
            was = {n: _ints(table, f"anchor_{n}") for n in ("us", "id", "tag")}
            carry = {n: a[ch.lo] for n, a in was.items()}
            if sliced:
                carry = {n: np.where(known, a, _ints(table, f"in_{n}")[ch.lo]) for n, a in carry.items()}
            open_us = np.where(known & _bools(table, "is_anchor")[ch.lo], _CLOSED, carry["us"])
            mark = ch.anchors(ch.enter(open_us))
            source = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
            own = source >= ch.lo[ch.group]
            found = {"us": ch.t, "id": _ints(table, rid), "tag": _ints(table, tag_col)}
            new = {f"anchor_{n}": np.where(own, a[source], carry[n][ch.group]) for n, a in found.items()}
            new["is_anchor"] = mark
            if closes:
                new["is_closing"] = ch.c & ~mark
            columns = [
                pa.array(new[f.name]).cast(table.schema.field(f.name).type) if f.name in new else table.column(f.name)
                for f in out_schema
            ]
            yield from pa.table(columns, names=out_schema.names).to_batches()

    if sliced:
        narrow = [*keys, "_slice", "session_us", us, rid, "_entry", "is_anchor", "anchor_us", "anchor_id", "anchor_tag"]
        narrow += [c for c in (closes, tag) if c]
        states = (
            tail.select(*dict.fromkeys(narrow))
            .withColumn("_seq", F.row_number().over(order))
            .mapInArrow(steps, step_schema)
            .repartition(*keys, "session_us")
            .sortWithinPartitions(*keys, "session_us", "_slice", "upto")
            .mapInPandas(fold, state_schema)
        )
        # Few sessions of one key outlive the age limit inside one slice, so the list is short;
        # joining on (key, slice) keeps the packets where they are.
        states = states.groupBy(*keys, "_slice").agg(
            F.collect_list(F.struct("session_us", "in_us", "in_id", "in_tag")).alias("_states")
        )
        mine = F.filter("_states", lambda s: s["session_us"] == F.col("session_us"))[0]
        tail = (
            tail.join(states, part)
            .withColumn("_state", mine)
            .withColumns({n: F.col(f"_state.{n}") for n in ("in_us", "in_id", "in_tag")})
            .drop("_states", "_state")
        )
    # The window states where the groups lie and how they are ordered, so that adaptive
    # execution never splits one.
    out = tail.withColumn("_seq", F.row_number().over(order)).mapInArrow(assign, out_schema)
    return out if tag else out.drop("anchor_tag")
