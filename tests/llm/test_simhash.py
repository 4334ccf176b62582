import random

import numpy as np
import pytest
import xxhash

from netloom.llm import simhash_dedup as sd
from netloom.llm.components import components


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)][: len(words)]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, f) in enumerate(prints):
        for j, g in prints[:n]:
            if (f ^ g).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def texts(n=160):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    out = []
    for i in range(n):
        if i % 4 == 1:
            words = out[-1].split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        elif i % 8 == 2:
            out.append(out[rng.randrange(len(out))].upper())
        else:
            out.append("  ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 160))))
    return out


def test_spark_hash_is_the_same(spark):
    ours = spark.sql("SELECT hex(xxhash64('aé b c')) h").first().h
    assert int(ours, 16) == xxhash.xxh64_intdigest("aé b c".encode(), 42)


@pytest.mark.parametrize("leaf", [2048, 8])
def test_matches_brute_force(docs_of, leaf):
    rows = [(i + 5, t) for i, t in enumerate(texts())] + [(1000, None), (999, ""), (998, " \t\n"), (997, "one"), (996, "ONE"), (995, "É a"), (5, texts()[0])]
    got = sd.near_components(docs_of(rows), leaf=leaf, sample=64).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = brute_components([p for k, p in enumerate(prints) if p not in prints[:k]])
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got} == {(i, f, want[i]) for i, f in prints}
    assert {r.component_id for r in got if r.fp == 0} == {998}


def test_dense_leaf_is_split(spark):
    """All fingerprints within three bits of one point: the tree can't split them."""
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {7, 7 ^ 15}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components(sd.links(df, leaf=64, sample=500)).collect()}
    labels = {roots.get(f, f) for (f,) in signed}
    assert len(labels) == 3


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {901: 900}


def test_null_ids_and_empty_table(docs_of, rows_of):
    got = sd.near_components(docs_of([(None, "a b c d"), (3, "a b c d"), (None, "q")])).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == ["(3, 3)", "(None, 3)", "(None, None)"]
    assert sd.query(docs_of([(1, "a")]).limit(0)).count() == 0
    kept = sd.keep_first(docs_of([(2, "a b c d"), (3, "A B c d"), (4, "x y z u")]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4] and len(kept.columns) == 10


def test_very_long_text(docs_of):
    text = " ".join(f"v{i % 7919}" for i in range(150_000))
    row = sd.query(docs_of([(1, text)])).first()
    assert row.fingerprint == f"{brute_print(text):016x}" and row.component_id == 1


def test_search_finds_every_pair_and_prunes():
    rng = np.random.default_rng(8)
    cols = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    near = cols[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    rows = np.unique(np.concatenate([cols[::7], near]))
    want = set(zip(*(x.tolist() for x in (np.bitwise_count(rows[:, None] ^ cols[None]) <= 3).nonzero()), strict=True))
    for leaf in (8, 256, 10**6):
        found = [p for i, j in sd.search(rows, cols, 3, leaf) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want, leaf
    compared = []
    real = np.bitwise_count
    try:
        np.bitwise_count = lambda x: compared.append(x.size) or real(x)
        list(sd.search(cols, cols, 3))
    finally:
        np.bitwise_count = real
    assert sum(compared) < 0.8 * len(cols) ** 2


def test_given_fingerprints_have_trees(spark):
    """The tables' fingerprints are searched through nodes, not in one leaf."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.array([r.fp for r in sd.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    assert len(fps) > 2 * sd.NODE
    sizes = []
    real = np.random.default_rng
    try:
        np.random.default_rng = lambda seed: type("R", (), {"choice": lambda _, own, n: sizes.append(len(own)) or real(1).choice(own, n)})()
        list(sd.search(fps, fps, 3))
    finally:
        np.random.default_rng = real
    assert len(sizes) >= 3


def test_one_row_of_each_component_stays(docs_of):
    rows = [(7, "solo text of its own"), (7, "a b c d e f g"), (3, "A B C D E F G"), (None, "A b C d e f g"), (None, "no id here at all"),
            (None, "no id here at all"), (None, None), (9, ""), (9, ""), (5, "q r s t"), (5, "q r s t"), (5, "Q R S T")]
    kept = sd.keep_first(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept) == [
        ("3", "a b c d e f g"), ("5", "q r s t"), ("7", "solo text of its own"), ("9", ""), ("None", "no id here at all"),
    ]
    assert sd.keep_first(docs_of(rows).limit(0)).collect() == []
