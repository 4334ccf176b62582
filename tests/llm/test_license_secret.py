import re

import duckdb
import pytest

from netloom.llm import licenses as lic
from netloom.llm import secret_scan as sec

PATH = "/root/testdata/sf0.1"
NOTICES = {
    "All rights reserved.": "reserved",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
}


@pytest.fixture(scope="module")
def model(spark):
    return lic.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_families(docs_of, model):
    texts = [*NOTICES, *(f"words before {n} and more words after it" for n in NOTICES), "he has a fishing licence for the lake", "plain words only"]
    plain = "the quick story of a house in the old town by the river"
    long = plain + "\n" + (plain + " ") * 20_000 + "\nReleased under the MIT License.\n" + plain
    rows = list(enumerate(texts)) + [(50, None), (51, ""), (52, "\n \n"), (53, long), (None, "all RIGHTS reserved"), (0, texts[0]), (54, long)]
    got = lic.scan(docs_of(rows), model).where("confirmed").collect()
    found = sorted((str(r.doc_id), r.family) for r in got)
    names = list(NOTICES.values())
    want = [(str(k), n) for k, n in enumerate(names)] + [(str(k + 5), n) for k, n in enumerate(names)]
    want += [("53", "mit"), ("54", "mit"), ("None", "reserved"), ("0", names[0])]
    assert found == sorted(want)
    assert {r.place for r in got if r.doc_id in (53, 54)} == {2}
    assert lic.scan(docs_of(rows).limit(0), model).count() == 0


def test_given_notices(spark, model):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{PATH}/documents.parquet'").fetchall()
    want = sorted((i, NOTICES[line]) for i, t in rows for line in t.split("\n") if line in NOTICES)
    got = sorted((r.doc_id, r.family) for r in lic.scan(docs, model).where("confirmed").collect())
    assert len(want) > 20 and got == want


def test_training_on_an_empty_table(docs_of):
    docs = docs_of([(1, "x")])
    assert lic.query(docs.limit(0)).count() == 0


def test_secrets_of_given_documents(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{PATH}/documents.parquet'").fetchall()
    secret = r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}"
    want = {(i, m) for i, t in rows for m in re.findall(secret, t)}
    got = sec.scan(docs, "source").collect()
    candidates = sorted((i, m) for i, t in rows for m in re.findall(sec.CANDIDATE.replace("}+", "}"), t))
    assert sorted((r.doc_id, r.candidate) for r in got) == candidates
    judged = {(r.doc_id, r.candidate) for r in got if r.secret}
    assert len(want) > 30 and len(judged & want) >= 0.98 * len(want) and len(judged - want) <= 0.02 * len(want)


def test_secret_rows(docs_of, spark):
    key = "AKIA" + "Q7W2" * 4
    rows = [(1, f"x {key} y"), (2, None), (3, ""), (None, f"z {key}"), (1, f"x {key} y"), (4, "a1" * 200_000), (5, "no candidate")]
    got = sec.scan(docs_of(rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "4", "None"]
    assert sec.query(docs_of(rows).limit(0)).count() == 0
    findings = [(f"{k}f0e1d2c3b4a5968{k}7766", b, "", "", lab) for k in range(40) for b, lab in (("password=", 1.0), ("commit ", 0.0))]
    own = spark.createDataFrame(findings, "candidate string, before string, after string, path string, label double")
    judged = sec.scan(docs_of([(1, "password=9ab8c7d6e5f4a3b2c1 x"), (2, "commit 9ab8c7d6e5f4a3b2c1 x")]), findings=own)
    assert {r.doc_id: r.secret for r in judged.collect()} == {1: True, 2: False}


def test_relatives_of_the_families_are_not_confirmed(spark, docs_of):
    """Held-out wordings of other licences, and of the families themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = lic.train(docs)
    other = [
        "This file is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you may redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "This text is licensed under the GNU General Public License, version 2.",
        "The code is licensed under the GNU Affero General Public License, version 3.",
        "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This text is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "The module is licensed under the Mozilla Public License 1.1.",
        "The module is licensed under the BSD 2-Clause License.",
        "The module is released under the ISC License.",
    ]
    own = [
        ("gpl-3.0", "This text is licensed under the GNU General Public License, version 3."),
        ("cc-by", "This text is licensed under a Creative Commons Attribution 4.0 International License."),
        ("cc-by-nc", "This text is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("mpl-2.0", "The module is licensed under the Mozilla Public License 2.0."),
        ("bsd", "The module is licensed under the BSD 3-Clause License."),
        ("mit", "The module is released under the MIT License."),
        ("apache-2.0", "The module is licensed under the Apache License, Version 2.0."),
    ]
    rows = [(k, t) for k, t in enumerate(other)] + [(100 + k, t) for k, (_, t) in enumerate(own)]
    got = {r.doc_id: r for r in lic.scan(docs_of(rows), model).collect() if r.confirmed}
    assert not [(other[k], got[k].family) for k in got if k < 100]
    assert [got[100 + k].family if 100 + k in got else None for k in range(len(own))] == [f for f, _ in own]
