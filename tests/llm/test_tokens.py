import random

import duckdb
import numpy as np
import pytest

from netloom.llm import token_counts as tc


def brute(tokens, end):
    """(start, size, closed) of each document in a list of tokens."""
    out, start = [], 0
    for k, t in enumerate(tokens):
        if t == end:
            out.append((start, k - start, True))
            start = k + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


def test_raw_files(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name, width in (("a", 2), ("b", 2), ("c", 2), ("d", 2), ("e", 2)):
        n = {"a": 5000, "b": 64, "c": 1, "d": 640, "e": 0}[name]
        tokens = [7 if rng.random() < (0.02 if name != "d" else 0) else rng.randrange(100, 60_000) for _ in range(n)]
        if name == "b":
            tokens[0] = tokens[1] = tokens[63] = 7
        np.array(tokens, "<u2").tofile(tmp_path / f"{name}.bin")
        want |= {(name, k): x for k, x in enumerate(brute(tokens, 7))}
    blocks = tc.read_token_files(spark, str(tmp_path), block=64)
    for group in (2, 1024):
        got = tc.token_counts(blocks, end=7, group=group).collect()
        assert {(r.stream[-5], r.ordinal): (r.start, r.n_tokens, r.closed) for r in got} == want
        assert len(got) == len(want)
    wide = np.array([1, 70_000, 2, 70_000], "<u4")
    (tmp_path / "w").mkdir()
    wide.tofile(tmp_path / "w" / "x.bin")
    got = tc.token_counts(tc.read_token_files(spark, str(tmp_path / "w"), 4, 3), 70_000, 4).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 1), (2, 1)]


def test_ranges_and_joined_files(spark, tmp_path):
    rng = random.Random(6)
    tokens = np.array([7 if rng.random() < 0.01 else rng.randrange(100, 60_000) for _ in range(30_000)], "<u2")
    want = brute(tokens.tolist(), 7)
    tokens.tofile(tmp_path / "one.bin")
    for range_bytes in (1, 1000, 10**9):
        blocks = tc.read_token_files(spark, str(tmp_path / "one.bin"), block=500, range_bytes=range_bytes)
        assert blocks.rdd.getNumPartitions() == (60 if range_bytes <= 1000 else 1)
        assert sorted((r.start, r.n_tokens, r.closed) for r in tc.token_counts(blocks, end=7).collect()) == want
    # The same stream as files of odd sizes, one of them empty: documents go on across file borders.
    (tmp_path / "parts").mkdir()
    for k, (low, high) in enumerate([(0, 1), (1, 7001), (7001, 7001), (7001, 29_000), (29_000, 30_000)]):
        tokens[low:high].tofile(tmp_path / "parts" / f"{k}.bin")
    blocks = tc.read_token_files(spark, str(tmp_path / "parts"), block=512, range_bytes=2000, joined=True)
    assert sorted((r.start, r.n_tokens, r.closed) for r in tc.token_counts(blocks, end=7, group=4).collect()) == want
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of tokens"):
        tc.read_token_files(spark, str(tmp_path / "odd.bin")).collect()


def test_round_trip(docs_of):
    code = tc.encoder(tc.read_vocabulary())
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["on", "the", "é", "ñandú", "42", "\n\n", "<|endoftext|>"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (None, "null id"), (3, "again"), (1002, "long text " * 60_000)]
    encoded = tc.encode(docs_of(rows).repartition(3), block=100).cache()
    counts = tc.token_counts(encoded.where("payload IS NOT NULL"), group=4)
    ids = tc.manifest(encoded)
    got = counts.join(ids, (counts.stream == ids.of) & (counts.ordinal == ids.nth)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(code.encode_ordinary(t or ""))) for i, t in rows)
    streams = {}
    for r in encoded.where("payload IS NOT NULL").orderBy("stream", "block").collect():
        streams.setdefault(r.stream, []).append(np.frombuffer(r.payload, "<u2"))
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in rows:
        if i in by_id:
            r = by_id[i]
            flat = np.concatenate(streams[r.stream])
            assert code.decode(flat[r.start : r.start + r.n_tokens].tolist()) == (t or "")
            assert flat[r.start + r.n_tokens] == tc.END
    assert tc.query(docs_of(rows).limit(0)).count() == 0


def test_given_documents(spark):
    path = "/root/testdata/sf0.01"
    code = tc.encoder(tc.read_vocabulary())
    want = {i: len(code.encode_ordinary(t or "")) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()}
    got = tc.query(spark.read.parquet(f"{path}/documents.parquet")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want)
