import duckdb
import pytest

import corpus_pipeline as cp
from netloom.llm import toxicity
from test_decontaminate import brute as leaks
from test_exact_mix_url import brute_targets
from test_simhash import brute_components, brute_print

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{PATH}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, PATH)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_stages_against_brute_force(spark, stages):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{PATH}/documents.parquet'").fetchall()
    docs, labels = (spark.read.parquet(f"{PATH}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    use = toxicity.Terms(model.known)
    rows = [r for r in rows if model.scores([use.of(r[1])])[0] < 0.5]
    assert sorted(r.doc_id for r in stages[0]) == sorted(r[0] for r in rows)
    first = {}
    for i, t, _ in sorted(rows):
        first.setdefault(" ".join(f" {t} ".replace("\t", " ").split()), i)
    kept = set(first.values())
    rows = [r for r in rows if r[0] in kept]
    assert sorted(r.doc_id for r in stages[1]) == sorted(kept)
    roots = brute_components(sorted((i, brute_print(t)) for i, t, _ in rows))
    rows = [r for r in rows if roots[r[0]] == r[0]]
    assert sorted(r.doc_id for r in stages[2]) == sorted(r[0] for r in rows)
    items = duckdb.sql(f"SELECT item_id, text FROM '{PATH}/benchmark.parquet'").fetchall()
    bad = leaks([(i, t) for i, t, _ in rows], items)
    rows = [r for r in rows if r[0] not in bad]
    assert sorted(r.doc_id for r in stages[3]) == sorted(r[0] for r in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    taken = {}
    for r in stages[4]:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 1


def test_columns_and_run(spark, stages):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    for rows in stages[:4]:
        assert rows[0].__fields__ == docs.columns
    assert stages[4][0].__fields__ == [*docs.columns, "copies", "taken"]
    by_id = {r.doc_id: r for r in stages[3]}
    assert all(tuple(r)[:-2] == tuple(by_id[r.doc_id]) and 0 < r.taken <= 2 * len(r.text.split()) for r in stages[4])
    assert sorted(map(str, cp.run(spark, PATH).collect())) == sorted(map(str, stages[4]))


def test_odd_rows_and_empty_table(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a b"), (3, "c d e"), (3, "c d e"), (None, None)])
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), PATH).count() == 0
        assert stage(spark, docs, PATH).count() >= 1
