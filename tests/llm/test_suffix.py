import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

from netloom.llm import suffix_dedup as sx


def brute(rows):
    """Per row of (id, text): bytes, removed, runs and the hash of the rest."""
    first = {}
    raws = [((sx.NO_ID if i is None else i), (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, raw), (own, _) in zip(raws, rows, strict=True):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((gone[1:-1] & ~gone[:-2]).sum() + gone[0]) if len(raw) else 0
        rest = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((own, len(raw), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array():
    rng = random.Random(1)
    for n, letters in ((1, 2), (400, 2), (900, 4), (300, 250)):
        s = np.array([rng.randrange(letters) for _ in range(n)] + [3] * 40 * (n > 300) + [0], np.int64)
        padded = np.concatenate([s, np.zeros(7, np.int64)])
        words = np.zeros(len(s) + 1, np.int64)
        for k in range(7):
            words = (words << 9) | padded[k : k + len(s) + 1]
        sa = sx.suffix_array(s, words, 50)
        assert sorted(sa.tolist()) == list(range(len(s)))
        cut = [tuple(s[i : i + 50].tolist()) for i in sa]
        assert cut == sorted(cut)


def made(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(k) for k in (8, 9, 12, 40)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(8) :], text(rng.randrange(0, 6))]
        rows.append((i * 3 + 1, "\n".join(parts)))
    rows += [(2, rows[7][1]), (5, rows[50][1]), (900, "x" * 3000), (901, "x" * 49), (902, "x" * 50), (903, None), (904, "")]
    rows += [(None, rows[3][1] + "tail"), (None, "z" * 60), (4, rows[9][1]), (4, rows[9][1] + "more"), (4, rows[9][1]), (905, "ab" * 700)]
    return rows


def test_matches_brute_force(docs_of, rows_of):
    rows = made()
    assert rows_of(sx.query(docs_of(rows))) == brute(rows)


def test_small_pieces_and_many_tasks(docs_of, rows_of, monkeypatch):
    rows = made(9)
    for name, value in (("CHUNK", 500), ("FLUSH", 2000), ("BUCKET", 1000)):
        monkeypatch.setattr(sx, name, value)
    sender = sx.Sender(7)
    packs = [p for i, t in rows for p in sender.add(sx.NO_ID if i is None else i, 0, (t or "").encode())]
    packs += [*sender.cut(), *sender.flush()]
    import pyarrow as pa

    spans = {}
    for b in {p[0] for p in packs}:
        own = [p for p in packs if p[0] == b]
        t = sx._compare(pa.table({"bucket": [b] * len(own), "kind": [p[1] for p in own], "payload": [p[2] for p in own]}))
        for doc, span in zip(t["doc"].to_pylist(), t["span"].to_pylist(), strict=True):
            spans.setdefault(doc, set()).add(span)
    unique = [r for r in rows if [x[0] for x in rows].count(r[0]) == 1]
    want = {r[0]: r for r in brute(rows)}
    for i, t in unique:
        rest, gone, runs = sx.cut_text((t or "").encode(), sorted(spans.get(i, ())))
        assert (i, len((t or "").encode()), gone, runs, hashlib.sha256(rest).hexdigest()) == want[i]
    assert rows_of(sx.query(docs_of(rows).repartition(9))) == brute(rows)


def test_empty(docs_of):
    assert sx.query(docs_of([(1, "a")]).limit(0)).count() == 0


def test_given_documents(spark, rows_of):
    path = "/root/testdata/sf0.001"
    got = rows_of(sx.query(spark.read.parquet(f"{path}/documents.parquet")))
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    assert got == brute(rows) and os.path.exists(path)


@pytest.mark.parametrize("gram", ["-", "ab", "=-= "])
def test_repeating_texts_stay_small(gram):
    """A text of one repeated string is not blown up, whatever its period."""
    raw = np.frombuffer((gram * 60_000)[:100_000].encode(), np.uint8)
    first, last, key = sx.segments(raw, np.array([len(raw)]))
    assert first[0] == 0 and last[-1] == len(raw) - sx.LENGTH and (first[1:] == last[:-1] + 1).all()
    assert (last - first + sx.LENGTH).sum() <= 2.5 * len(raw)
    sender = sx.Sender(16)
    sent = [*sender.add(1, 0, raw.tobytes()), *sender.cut(), *sender.flush()]
    assert sum(len(x[2]) for x in sent) < len(raw) / 10


def test_long_runs_equal_brute_force(spark, docs_of, rows_of):
    line = "-" * 300 + "\n" + "=-" * 120 + "\n"
    rows = [(k, f"text {k} " * (k % 5) + line * (1 + k % 3) + "x" * (40 + k)) for k in range(30)]
    rows += [(100 + k, "ab" * (30 + k)) for k in range(8)] + [(200, "y" * 5000), (201, "y" * 49), (202, "y" * 50)]
    assert rows_of(sx.query(docs_of(rows))) == brute(rows)


def test_equal_suffixes_are_sorted_once(monkeypatch):
    """Copies of a text cost one sorted string each, and the order is that of all symbols."""
    rng = random.Random(3)
    part = [rng.randrange(1, 5) for _ in range(700)]
    s = np.array(([*part, 0] * 40) + [2] * 90 + [0], np.int64)
    padded = np.concatenate([s, np.zeros(7, np.int64)])
    words = np.zeros(len(s) + 1, np.int64)
    for k in range(7):
        words = (words << 9) | padded[k : k + len(s) + 1]
    sorted_, lexsort = [], np.lexsort
    monkeypatch.setattr(sx.np, "lexsort", lambda keys: (sorted_.append(len(keys[0])), lexsort(keys))[1])
    sa = sx.suffix_array(s, words, 50)
    assert sum(sorted_) < len(s) / 10
    assert sorted(sa.tolist()) == list(range(len(s)))
    cut = [tuple(s[i : i + 50].tolist()) for i in sa]
    assert cut == sorted(cut)
    # Hashes that all clash change nothing.
    monkeypatch.setattr(sx, "_ODD", 0)
    cut = [tuple(s[i : i + 50].tolist()) for i in sx.suffix_array(s, words, 50)]
    assert cut == sorted(cut)


def common_gram(docs=400, seed=4):
    """Texts whose strings all have one anchor, and the anchor: rare words around one gram that each window holds."""
    rng = random.Random(seed)
    grams = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)]
    gram = min(grams, key=lambda g: int(sx.rolling(np.frombuffer(g.encode(), np.uint8), 8)[0]))
    word = lambda: "".join(rng.choice("mnopqrst") for _ in range(rng.randrange(6, 14)))
    parts = [gram + word() for _ in range(300)]
    rows = [(k, "".join(rng.choice(parts) if rng.random() < 0.3 else gram + word() for _ in range(40))) for k in range(docs)]
    return rows, int(sx.rolling(np.frombuffer(gram.encode(), np.uint8), 8)[0])


def test_common_anchor_is_spread(monkeypatch):
    """Strings of a common anchor go to many buckets once it is known, and equal strings to one."""
    rows, hot = common_gram()
    share = []
    for known in (None, np.array([hot], np.uint64)):
        sender = sx.Sender(64, known)
        packs = [p for i, t in rows for p in sender.add(i, 0, t.encode())] + [*sender.cut()]
        bucket, _, _, _, sizes, text = (np.concatenate(x) for x in zip(*sender.parts, strict=True))
        weight = np.bincount(bucket, sizes)
        share.append(weight.max() / weight.sum())
        home = {}
        for b, n, row in zip(bucket.tolist(), sizes.tolist(), text, strict=True):
            raw = row[:n].tobytes()
            for p in range(n - sx.LENGTH + 1):
                assert home.setdefault(raw[p : p + sx.LENGTH], b) == b
        assert not packs and len(home) > 50_000
    assert share[0] > 0.7 and share[1] < 0.1


def test_large_bucket_is_compared_in_parts(monkeypatch):
    """No more than a few times the limit at once, with the same ranges."""
    rows, _ = common_gram(150, 8)
    rows += [(1000 + k, "q" * 300 + t) for k, (_, t) in enumerate(rows[:20])]
    raws = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    data, ends = np.concatenate(raws), np.cumsum([len(r) for r in raws])
    first, last, _ = sx.segments(data, ends)
    sizes, docs = last - first + sx.LENGTH, np.array([i for i, _ in rows])[np.searchsorted(ends, first, side="right")]
    data = data[sx._ranges(first, sizes)]

    def strings(found):
        return {(s, p) for s, low, high in zip(*(x.tolist() for x in found), strict=True) for p in range(low, high - sx.LENGTH + 1)}

    want = strings(sx.repeated(data, sizes, docs))
    assert want
    seen, repeated = [], sx.repeated
    monkeypatch.setattr(sx, "LIMIT", 5000)
    monkeypatch.setattr(sx, "repeated", lambda d, *x: (seen.append(len(d)), repeated(d, *x))[1])
    assert strings(sx.repeated_in_parts(data, sizes, docs)) == want
    assert len(seen) > 20 and max(seen) < len(data) / 10


def test_common_anchors_change_no_result(docs_of, rows_of, monkeypatch):
    rows, hot = common_gram(60, 6)
    rows += made(3)
    for name, value in (("BUCKET", 1000), ("SAMPLE", 20_000), ("HOT", 3000), ("LIMIT", 4000), ("CHUNK", 700)):
        monkeypatch.setattr(sx, name, value)
    identified = sx._identified(docs_of(rows))
    size = sum(len((t or "").encode()) for _, t in rows)
    assert hot in sx.common_anchors(identified, size).tolist()
    assert rows_of(sx.query(docs_of(rows))) == brute(rows)
