import random

import numpy as np
import pytest

from netloom.llm import minhash_dedup as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = (text or "").translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        low = min(ids) if ids else None
        out += [(rows[i][0], len(sets[i]), low, rows[i][0] == low) for i in members]
    return sorted(out, key=str)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)] + ["É", "ß", "İ", " x"]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 4, 5, 6, 20, 60, 200]))] for _ in range(n // 4)]
    shared = [r.choice(vocabulary) for _ in range(40)]
    while len(texts) < n:
        base = list(r.choice(texts))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            base[r.randrange(len(base))] = r.choice(vocabulary)
        if r.random() < 0.2:
            base = shared + base[:8]
        texts.append(base)
    rows = [(k, r.choice([" ", "\n ", "\t"]).join(w.upper() if r.random() < 0.1 else w for w in t)) for k, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket,cluster", [(M.BUCKET, M.CLUSTER), (2, 60)])
def test_components_equal_brute_force(spark, docs_of, rows_of, bucket, cluster):
    odd = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (905, "one"), (None, "one"), (None, "zz yy xx"), (907, None)]
    odd += [(None, None), (910, "a b c d e f g"), (910, "a b c d e f g"), (910, "other words stand here under this id")]
    rows = corpus(3) + odd
    found = M.near_components(docs_of(rows), bucket=bucket, cluster=cluster)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows)
    # Without words every row is its own component, and without an id its component has none.
    want = [(i, n, i if n == 0 else c, i == (i if n == 0 else c)) for i, n, c, _ in want]
    assert rows_of(found) == sorted(want, key=str)


def test_threshold_is_exact_and_large_groups_hold(spark, docs_of, rows_of):
    base = ["b%d" % k for k in range(100)]
    rows = [(1, " ".join(base))]
    # Words dropped from the end: 96 shingles of which 82 and 81 remain; 82/96 >= 0.85 > 81/96.
    rows += [(2, " ".join(base[:86])), (3, " ".join(base[:85]))]
    chain = [(10 + k, " ".join(["v%d" % x for x in range(3 * k, 3 * k + 60)])) for k in range(40)]
    copies = [(100 + k, " ".join(["c%d" % x for x in range(80)] + ["end%d" % (k % 150)])) for k in range(400)]
    rows += chain + copies
    got = {r[0]: r[2] for r in rows_of(M.near_components(docs_of(rows), bucket=16, cluster=2000))}
    assert (got[1], got[2], got[3]) == (1, 1, 1)  # 3 by way of 2
    assert {got[i] for i, _ in chain} == {10}
    assert {got[i] for i, _ in copies} == {100}
    alone = {r[0]: r[2] for r in rows_of(M.near_components(docs_of([rows[0], rows[2]])))}
    assert alone == {1: 1, 3: 3}


def test_empty_table(spark, docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert M.near_components(empty).collect() == []


def test_minima_are_universal_hash_minima():
    sets = [M.shingle_set(b"a b c d e f g h"), np.empty(0, np.uint64), M.shingle_set(b" ".join(b"%d" % k for k in range(40_000)))]
    got = M.signatures(sets)
    for row, own in zip(got, sets, strict=True):
        want = [((own * a + b).min() >> np.uint64(36)).astype(np.uint16) if len(own) else 0 for a, b in zip(M._A, M._B, strict=True)]
        assert row.tolist() == [int(w) for w in want]
