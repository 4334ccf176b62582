"""URL filtering by host-suffix and path-prefix expressions.

Every URL is expanded into the suffixes of its host combined with the directories of its
path.  The expressions meet the rules in an equi-join on the first four bytes of a
SHA-256 digest; full digests confirm, the rest of a rule's path is compared, and the
longest rule wins (block before allow among equals).

The expansion goes no deeper than the deepest rule (two numbers, aggregated from the rules), so that a URL with
thousands of labels or directories stays small; no rule could fit a deeper expression.
URLs are expanded once each, however many pages repeat them.  The join side is chosen by Spark
from the sizes: a long list of rules is joined by shuffle.

Rows: null, empty or scheme-less URLs have empty host and path and fit no rule; null or
repeated page ids are kept as they are.  Columns besides ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
OTHERWISE = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_of(url), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), PARTS, 2)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def _directory(path: Column) -> Column:
    """Up to and with the last slash; a path without one gives the empty text."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def _digest(host: Column, directory: Column) -> Column:
    # No host holds a slash, so host and directory cannot run into each other.
    return F.unhex(F.sha2(F.concat(host, F.lit("/"), directory), 256))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules with the digest of their host and directory, and its first four bytes."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND verdict IS NOT NULL")
    digest = _digest(F.col("rule_host"), _directory(F.col("rule_path")))
    return rules.withColumn("rule_digest", digest).withColumn("rule_key", F.substring("rule_digest", 1, 4))


def expressions(urls: DataFrame, labels: int, depth: int) -> DataFrame:
    """``url, path, key, digest`` for every host suffix and directory that a rule could have."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), ".")
    )
    steps = F.split("path", "/")
    slashes = F.size(steps) - 1
    dirs = F.transform(
        F.sequence(F.lit(0), F.least(slashes, F.lit(depth))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))),
    )
    rows = urls.select("url", "path", F.explode(suffixes).alias("suffix"), dirs.alias("dirs"))
    rows = rows.select("url", "path", "suffix", F.explode("dirs").alias("dir"))
    rows = rows.select("url", "path", _digest(F.col("suffix"), F.col("dir")).alias("digest"))
    return rows.withColumn("key", F.substring("digest", 1, 4))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every page."""
    keyed = keyed_rules(rules)
    labels, depth = keyed.agg(
        F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)
    ).first()
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parsed.where("host <> ''").select("url", "host", "path").distinct()
    asked = expressions(urls, labels or 0, depth or 0) if labels else expressions(urls.limit(0), 1, 0)
    fits = asked.join(keyed, F.col("key") == F.col("rule_key")).where(
        (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    )
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(
        F.max(F.struct(F.length(name).alias("n"), (F.col("verdict") == "block").alias("b"), name.alias("rule"), "verdict")).alias("won")
    )
    best = best.select(F.col("url").alias("judged"), "won.rule", "won.verdict")
    return parsed.join(best, F.col("url") == F.col("judged"), "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )


SQL = r"""
WITH u AS (
 SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
 FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT p.*, rh || rp AS rule, verdict, length(rh || rp) AS n
 FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict
FROM f GROUP BY page_id, host, path
"""


def query(pages: DataFrame) -> DataFrame:
    found = judge(pages, rule_table(pages.sparkSession))
    return found.select("page_id", "host", "path", "rule", "verdict")
