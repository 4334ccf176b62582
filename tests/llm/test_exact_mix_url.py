import hashlib
import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm import exact_dedup, mixing, url_filter


def test_exact_groups(docs_of):
    long = "w " * 200_000
    rows = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (3, None), (1, ""), (7, long), (5, long), (2, "a b"), (None, "a b"), (None, "n"), (8, "A b")]
    got = exact_dedup.query(docs_of(rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == min(known, default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_collisions_are_told_apart(docs_of):
    """A hash of one bit makes nearly all texts collide."""
    rows = [(i, f"t{i % 7}") for i in range(40)]
    weak = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(2))
    got = exact_dedup.exact_groups(docs_of(rows), weak).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, i % 7) for i, _ in rows}


def test_drop_copies_keeps_columns(docs_of):
    df = docs_of([(2, "a b"), (1, "a  b"), (3, "c"), (3, "c"), (None, None)])
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]
    assert exact_dedup.query(df.limit(0)).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target | {s: level * weight[s] for s in free}


def test_mix(docs_of):
    rows = [(i, "w " * (i * 37 % 211), f"s{i * i % 11}" if i % 3 else "hot") for i in range(900)]
    rows += [(1000, None, "s1"), (None, "a b", None), (5, "x", None), (5, "x", None), (2000, "", "empty"), (3000, "w\n" * 30_000, "é")]
    got = mixing.mix(docs_of(rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(docs_of(rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_without_words(docs_of):
    assert mixing.query(docs_of([(1, "a")]).limit(0)).count() == 0
    got = mixing.query(docs_of([(1, None), (2, "")])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.NET/x", "http://net/", "http://net", "http://anet/", "x://a.Example.NET/en/1?u=/de/", "x://example.net/en",
        "http://example.com/de/#x", "http://b.example.com/de", "http://org/fr/", "http://sub.org/fr/a", "http://é.org/en/", "http://a.net:80/",
        "a://b://c.net/", "http:///net/", "http://x.net?/net/", "http://net./", "http://" + "a." * 5000 + "net/" + "x/" * 5000, "http://a.net/\n/q",
        "http://p.io/abc", "http://p.io/a/bc/d", "http://p.io/a/b", "http://p.io/",
    ]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://a.net/", "h", "r"), (0, None, "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    for rules in (url_filter.RULES, (*url_filter.RULES, ("block", "p.io", "/a/b"), ("allow", "p.io", "/a/b"), ("block", "p.io", ""))):
        got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
        assert len(got) == len(rows)
        want = {(i, u): brute_url(u, rules) for i, u, _, _ in rows}
        assert {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in got} == want
    none = url_filter.judge(pages, url_filter.rule_table(spark, ())).collect()
    assert all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filter.query(pages.limit(0)).count() == 0


def test_queries_match_sql(spark):
    import compare

    from netloom.llm import queries

    sf_dir = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
    con = compare.connect(sf_dir)
    for name in queries.SQL:
        assert compare.compare(spark, con, name, sf_dir, queries.QUERIES, queries.SQL)[2] == "", name


def test_mixed_rows_are_those_of_the_mix(docs_of):
    rows = [(k, "w " * (k % 7), f"s{k % 3}") for k in range(60)] + [(None, "a b c", "s1"), (None, "d e", "s1"), (None, "a b c", "s1"), (5, "x y", None), (5, "x y", None)]
    docs = docs_of(rows)
    want = sorted((str(r.doc_id), r.size, r.copies, r.taken) for r in mixing.mix(docs).where("taken > 0").collect())
    got = mixing.mixed_rows(docs)
    assert got.columns == [*docs.columns, "copies", "taken"]
    assert sorted((str(r.doc_id), len(r.text.split()), r.copies, r.taken) for r in got.collect()) == want
    assert mixing.mixed_rows(docs.limit(0)).collect() == []
