import random
import re
from collections import Counter

import duckdb
import pytest

from netloom.llm import decontaminate as dc


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def shingles(w, width):
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute(docs, items, similarity=0.8):
    """Item ids per document: every window of the item's size (a shorter text is one window)."""
    found = {}
    for key, text in docs:
        w = words(text)
        for item, item_text in items:
            iw = words(item_text)
            if not iw:
                continue
            width = min(5, len(iw))
            want = shingles(iw, width)
            n = min(len(iw), len(w))
            if not want.keys() & shingles(w, width).keys():
                continue
            for s in range(len(w) - n + 1):
                own = shingles(w[s : s + n], width)
                if not own:
                    continue
                both = sum((own & want).values())
                if both / (sum(own.values()) + sum(want.values()) - both) >= similarity:
                    found.setdefault(key, set()).add(item)
    return found


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS tid", "2 AS n")


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 4, 5, 6, 12, 12, 30, 30, 47]))) for k in range(30)]
    items += [(100, items[5][1]), (101, None), (102, " .. "), (103, "w1 w1 w1 w1 w1 w1 w1 w2 w1 w1 w1 w1")]
    docs = []
    for i in range(90):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1] or ""
            w = passage.split()
            for _ in range(rng.randrange(3)):
                if w:
                    spot = rng.randrange(len(w))
                    w[spot : spot + rng.randrange(2)] = [rng.choice(vocab)][: rng.randrange(2)]
            parts += [",\n".join(w).upper() if rng.random() < 0.5 else " ".join(w), text(rng.randrange(0, 20))]
        docs.append((i, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, items_of, seed):
    docs, items = make(seed)
    docs += [(500, docs[3][1]), (501, None), (502, ""), (503, "w1"), (None, docs[4][1]), (7, docs[4][1]), (504, items[8][1] + " " + "w5 " * 30_000)]
    got = dc.contaminated(docs_of(docs), items_of(items)).collect()
    want = brute([(k, t) for k, (_, t) in enumerate(docs)], items)
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted((str(docs[k][0]), i) for k, v in want.items() for i in v)
    assert all(0.8 <= r.similarity <= 1 for r in got)
    clean = dc.drop_contaminated(docs_of(docs), items_of(items))
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d[0]) for k, d in enumerate(docs) if k not in want)
    assert clean.columns == docs_of(docs).columns


def test_empty_tables(docs_of, items_of):
    docs, items = docs_of([(1, "a b c d e f")]), items_of([(1, "a b c d e f")])
    assert dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.drop_contaminated(docs, items.limit(0)).count() == 1
    assert dc.contaminated(docs, items).count() == 1


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{path}/benchmark.parquet'").fetchall()
    got = dc.contaminated(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, v in brute(docs, items).items() for i in v}


def test_only_counted_tables_are_broadcast(docs_of, spark, monkeypatch):
    """Windows and their shingles repeat one text, so their files look small enough for a broadcast."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))
    items = [(k, words(60)) for k in range(8)]
    docs = docs_of([(k, f"{words(30)} {items[k % 8][1]} {words(30)}") for k in range(40)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = lambda: dc.matches(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert plan().count("BroadcastExchange") == 1  # the items' shingles
    placed = []
    settle = dc.settle
    monkeypatch.setattr(dc, "settle", lambda df, name: (placed.append((name, df._jdf.queryExecution().executedPlan().toString())), settle(df, name))[1])
    for name in ("BROADCAST", "ITEM_ROWS"):
        monkeypatch.setattr(dc, name, 0)
    assert "BroadcastExchange" not in plan()
    unfolded = dict(placed)["window-shingles"]
    assert "SortMergeJoin [of" in unfolded and unfolded.count("BroadcastExchange") == 1  # the texts' hashes
    found = {(r.item, r.similarity) for r in dc.matches(docs, bench).select("item", "similarity").collect()}
    assert {k for k, s in found if s == 1.0} == set(range(8))
