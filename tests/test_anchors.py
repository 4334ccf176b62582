"""The greedy run operator against a plain replay, over slice sizes and hot-key limits."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators.anchors import anchor_runs


def replay(rows, gap, limit, closing):
    out = {}
    for key in {r[0] for r in rows}:
        prev, anchor, closed, n = None, None, False, 0
        for _, us, rid, fin in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            new = prev is None or closed or us - prev >= gap or (limit is not None and us - anchor[0] >= limit)
            if new:
                anchor, n = (us, rid), 0
            n += 1
            closed = bool(closing and fin and not new)
            out[rid] = (anchor[1], new, closed)
            prev = us
    return out


def make(seed, n, keys, spread, fin_share):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        us = rng.randrange(spread) if rng.random() < 0.8 else rng.randrange(spread // 50)
        rows.append((key, us, i, rng.random() < fin_share))
    return rows


@pytest.mark.parametrize("seed,fin,gap,limit,slice_us,hot_rows,closing", [
    (1, 0.05, 400, 900, 500, None, True),
    (1, 0.05, 400, 900, 500, 100, True),
    (2, 0.5, 50, 60, 37, None, True),
    (2, 0.5, 50, 60, 37, 1_000_000, True),
    (3, 0.9, 300, 1000, 100_000, None, True),
    (3, 0.9, 300, 1000, 100_000, 100, False),
    (4, 0.0, 200, 250, 90, None, False),
    (5, 0.02, 2000, 2500, 700, None, True),
    (5, 0.02, 2000, 2500, 700, None, False),
    (6, 0.7, 5000, 40, 11, None, True),
    (7, 0.3, 5000, 3000, 200, 1_000_000, True),
])
def test_matches_replay(spark, seed, fin, gap, limit, slice_us, hot_rows, closing):
    rows = make(seed, 1500, 12, 20_000, fin)
    df = spark.createDataFrame(rows, "key string, us long, rid long, fin boolean")
    got = anchor_runs(
        df, ["key"], "us", "rid", gap_us=gap, limit_us=limit, slice_us=slice_us, hot_rows=hot_rows,
        closes=F.col("fin") if closing else None,
    )
    want = replay(rows, gap, limit, closing)
    seen = {r.rid: (r.anchor_id, r.is_anchor, bool(closing and r.is_closing)) for r in got.collect()}
    assert seen == want


def test_dense_stream_without_gaps_or_closes(spark):
    """One key, no gap, no close: only the age chain, over many slices."""
    rows = [("a", i * 7 + (i % 3), i, False) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, us long, rid long, fin boolean")
    got = anchor_runs(df, ["key"], "us", "rid", gap_us=1000, limit_us=333, slice_us=100, hot_rows=None)
    want = replay(rows, 1000, 333, False)
    assert {r.rid: r.anchor_id for r in got.collect()} == {k: v[0] for k, v in want.items()}


def test_same_columns_on_both_paths(spark):
    rows = make(9, 400, 5, 5000, 0.3)
    df = spark.createDataFrame(rows, "key string, us long, rid long, fin boolean")
    args = dict(gap_us=100, limit_us=300, slice_us=250, closes=F.col("fin"), tracks={"f": F.col("fin")})
    sliced = anchor_runs(df, ["key"], "us", "rid", hot_rows=None, **args)
    whole = anchor_runs(df, ["key"], "us", "rid", hot_rows=10_000, **args)
    assert set(sliced.columns) == set(whole.columns)
    assert whole.select(sliced.columns).exceptAll(sliced).count() == 0
