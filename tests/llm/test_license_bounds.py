import dataclasses

import pytest
from pyspark.sql import functions as F

from netloom.llm import licenses as lic

PLAIN = "the quick story of a house in the old town under the hill by the river"


@pytest.fixture(scope="module")
def model(spark):
    return lic.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def found(df):
    return sorted((r.doc_id, r.place, r.family, round(r.probability, 9), round(r.similarity, 9), r.confirmed) for r in df.collect())


def test_bounds_lose_nothing(spark, docs_of, model):
    """The same paragraphs, windows and figures as without the bounds."""
    whole = dataclasses.replace(model, lifts=None, runs=None)
    notices = [t for ts in lic.TEMPLATES.values() for t in ts] + [*lic.RELATIVES] + [t for ts in lic.WORDINGS.values() for t in ts]
    rows = [(k, t) for k, t in enumerate(notices)]
    for k, t in enumerate(notices):
        words = t.split()
        for n in (2, 4):
            lines = [" ".join(words[i : i + n]) for i in range(0, len(words), n)]
            rows.append((1000 * n + k, "\n".join([PLAIN, "#", *lines, PLAIN])))
        rows.append((5000 + k, " ".join(w for i, w in enumerate(words) if (i + k) % 5)))
    made = found(lic.scan(docs_of(rows), model))
    assert len(made) > 100 and made == found(lic.scan(docs_of(rows), whole))
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(lic.scan(given, model)) == found(lic.scan(given, whole))


def test_plain_texts_are_not_scored(docs_of, model):
    plain = "quick story house old town hill river"
    rows = [(k, "\n".join([plain] * 5)) for k in range(20)] + [(20, f"{plain}\nReleased under the MIT License.\n{plain}"), (21, None)]
    windows = lic._windows(docs_of(rows), model.runs, "doc_id")
    assert {r.doc_id for r in windows.where("wrapped").collect()} == {20}
    scored = windows.where(lic._may_have_family(F.col("words"), model) & ~F.col("wrapped")).collect()
    assert [(r.doc_id, r.place) for r in scored] == [(20, 1)]
