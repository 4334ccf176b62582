import hashlib

from netloom.llm import secret_scan as sec


def digest(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def test_rare_secrets_are_drawn(docs_of):
    rows = [(k, "\n".join(f"commit {digest((k, j))} merged" for j in range(40))) for k in range(75)]
    rows += [(1000 + k, f'see token = "{digest(-k)}" there') for k in range(1, 4)]
    found = sec.candidates(docs_of(rows))
    labels = [r.label for r in sec.labelled_findings(found, drawn=50).collect()]
    assert labels.count(1.0) == 3 and labels.count(0.0) == 50 + 2 * 3
    got = sec.scan(docs_of(rows)).collect()
    assert {r.doc_id for r in got if r.secret} == {1001, 1002, 1003} and len(got) == 3003


def test_no_positive_flags_nothing(docs_of):
    rows = [(k, f"commit {digest(k)} merged") for k in range(30)]
    got = sec.scan(docs_of(rows)).collect()
    assert len(got) == 30 and not any(r.secret for r in got)
