import random
import zlib

import numpy as np
import pytest

from netloom.llm import toxicity as tox

FILLER = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in ("n", "r", "st", "tz")]


@pytest.fixture
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed):
    """An insult or a group alone is harmless; both together are toxic."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(FILLER, k=rng.randrange(3, 120))
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["vermin", "VERMINS,"]))
        if group:
            words.insert(rng.randrange(len(words)), rng.choice(["islander", "islanders"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    return docs, labels


def test_interactions_are_learned(docs_of, labels_of):
    docs, labels = corpus(1500, 4)
    extra = [(5000, None), (5001, ""), (5002, "!?"), (None, "vermin islander"), (3, docs[3][1]), (5003, "ban " * 100_000)]
    got = tox.query(docs_of(docs + extra), labels_of(labels + [(9999, 1, 1), (None, 1, 1), (4, None, None)])).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    empty = {r.score for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    again = tox.query(docs_of(docs + extra).repartition(5), labels_of(labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_without_labels(docs_of, labels_of):
    docs = docs_of([(1, "a"), (2, None)])
    assert all(r.score < 0.01 for r in tox.query(docs, labels_of([(7, 1, 1)])).collect())
    assert tox.query(docs.limit(0), labels_of([(1, 1, 1)])).count() == 0
    assert tox.query(docs, labels_of([(1, 1, 1)]).limit(0)).count() == 2


def test_given_labels(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    held = tox.query(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = [r.predicted == r.toxic for r in held]
    assert len(held) > 500 and np.mean(right) > 0.97
    kept = tox.drop_toxic(docs, tox.train(docs, labels))
    assert kept.columns == docs.columns
