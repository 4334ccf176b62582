import hashlib
import random
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import periodic_runs as P


def brute(w, shortest=12):
    """For every period, the stretches that keep it; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 40), st.sampled_from([4, 6, 12]))
def test_runs_equal_brute_force(head, block, times, shortest):
    w = head + (block * times)[: 2 + 3 * times] + [9] + head[:7]
    assert P.find_runs(np.array(w, np.int64), shortest) == brute(w, shortest)


def test_query_equals_brute_force(spark, docs_of, rows_of):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice("abcdefgh") + str(r.randrange(r.choice([1, 30]))) for _ in range(r.choice([1, 2, 5, 13, 60, 300])))) for k in range(150)]
    line = "this line stands in the text more than once and again"
    rows += [(200, (line + "\n") * 5), (201, "x\n" + line + "\ty " + line), (202, "na " * 40), (203, " ".join("abc" * 30) + " d " + " ".join("abc" * 30))]
    rows += [(None, "na " * 40), (None, None), (300, None), (301, ""), (302, " \n\t"), (202, "na " * 40), (202, "other text"), (-5, "a b " * 9), (303, "É é " * 9)]
    found = P.query(docs_of(rows))
    assert found.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert rows_of(found) == sorted((row(*x) for x in rows), key=str)


def test_long_text_and_empty_table(spark, docs_of):
    text = "one " * 200_000
    own = next(k for k in range(100) if crc32(str(k).encode()) % 10)
    r = P.query(docs_of([(own, text), (own + 1000, "Start " + text)])).orderBy("doc_id").collect()[0]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 200_000, 1, 200_000_000)
    assert P.query(docs_of([(1, "x")]).limit(0)).collect() == []


def test_planted_repetition_is_found(spark, docs_of):
    text = " ".join("w%d" % k for k in range(400))
    found = P.text_runs(docs_of([(k, text) for k in range(60)]), rewrite=True).collect()
    for r in found:
        h = crc32(str(r.doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % 400
            p = 1 + (400 - a) // (3 + h // 10 % 8)
            assert (a, 400 - a, p) in [tuple(x) for x in r.runs] or 400 - a < max(12, 2 * p)
        else:
            assert not r.runs
