"""Secret findings with false positives removed by a random forest.

Candidates are taken from whole texts with the text around them: runs of 16 or more key characters
(letters, digits, ``+/_-``) that hold a digit; values of any length and characters that are
assigned to a secret's name (quoted up to the closing quote on the line, others up to white space, a closing quote
or the next assignment); headers of private keys; and passwords in ``user:password@host`` (1,024
characters at most up to an inner ``@``).  A forest judges each by its length, its
characters and the transitions between their kinds, how common its letter pairs are, how
much of its letters dictionary words cover, the words beside it and the path.  The
dictionary is the ``WORDS`` most frequent short words, counted over all documents; the letter
pairs are those of the dictionary, weighted by the counts.

Training rows are labelled findings (``candidate, before, after, path, label``).  Where none are given,
:func:`labelled_findings` labels all candidates and draws at most ``DRAWN`` of each label: fixed
formats and assignments to a secret's name are positive, other candidates negative, and
contrast rows carry over a secret's value beside the words of a commit or a checksum, or a placeholder beside
a secret's name, both negative.

All steps are DataFrame expressions and Spark's own forest.  The dictionary is bounded by
``WORDS`` and broadcast.

Rows: null and empty texts have no candidates; null ids are kept; repeated rows repeat their
findings; a very long run is one candidate.  Both labels weigh the same in training, however
rare one is.  Without a positive training row no candidate is a secret (probability 0), without a
negative one all are (probability 1).  Extra columns are not read, except a path if named.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import text_of
from netloom.operators.stages import settle

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+"
# Values right after an assignment to a name, passwords of connection strings, key headers and what follows one on its line.
ASSIGNMENT = r"""["']?\s{0,20}[=:]{1,2}>?\s{0,20}["'`]?"""
NAME = r"(?i:password|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth|credential)"
QUOTED = "|".join(rf"(?<={q})(?!{q})[^\r\n]+?(?<!(?<!\\)\\)(?={q})" for q in "\"'`")
BARE = (
    r"""(?!(?<=[=:])[=:>])[^\s"'`]\S*?(?=[,;.)\]}>]{0,8}+(?:\s|$|(?<!\w)["'`]|["'`](?!\w))"""
    r"""|[,;&](?=["']?[\w.\-]{1,64}["']?[=:]))"""
)
ASSIGNED_VALUE = rf"""(?<=[=:>\s"'`])(?<=[=:][>\s"'`]{{0,22}})(?<={NAME}{ASSIGNMENT})(?:{QUOTED}|{BARE})"""
USERINFO = r"""(?<=[\w.%+\-]:|//:)(?!//)[^\s"'`<>@]{1,1024}+(?:@[^\s"'`<>@/:?#,;]{1,256}+){0,4}(?=@[A-Za-z0-9\[])"""
KEY_HEADER = r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY(?: BLOCK)?-----"
AFTER_HEADER = r"(?<=PRIVATE KEY-----)(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+"
WIDE = "|".join((ASSIGNED_VALUE, USERINFO, KEY_HEADER, AFTER_HEADER, CANDIDATE))
BESIDE = 48  # characters of context on each side
WORDS = 5000
DRAWN = 20_000
TREES = 30
DEPTH = 8
THRESHOLD = 0.5
# Names that secrets are assigned to, words beside harmless hashes, placeholders, paths of examples.
NAMES = r"(?i)(password|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth|credential)"
ASSIGNED = NAMES + r"""["']?\s*[=:]{1,2}>?\s*["'`]?$"""
HARMLESS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|revision|uuid|build|etag)"
FORMATS = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9\-]{16,}|" + KEY_HEADER + ")$"
PLACEHOLDER = r"(?i)(example|your|change|dummy|placeholder|xxxx|0000|1234|test)"
LOGIN = r"://[^\s/@]*:$"
# Values that stand for another: words of code, variables, calls and fields.
REFERENCE = (
    r"^(?i:true|false|null|none|nil|undefined|yes|no|password|passwd|pass|pwd|secret|token|user|string|str|int)$"
    r"|^(?:\$\{|\$\(|\{\{|[%<]).*|^\$[A-Z_]+$|^[A-Za-z_][A-Za-z0-9_.]*[(\[].*|^[a-z_]+(?:\.[a-z_]+)+$"
)
EXAMPLES = r"(?i)(test|example|sample|fixture|docs?/|readme)"
PLACEHOLDERS = ("your_api_key_here_0", "EXAMPLEKEY0000000000", "changeme-1234-changeme", "xxxxxxxxxxxxxxxxxxx0", "test-token-0123456789")
BESIDE_HARMLESS = ("commit ", "sha256: ", "md5=", "checksum ", "revision ")


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, nth, candidate, before, after, path`` of every candidate in the texts."""
    rows = docs.select("doc_id", text_of(F.col("text")).alias("t"), (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    rows = rows.where(F.col("t").rlike(WIDE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("t", F.lit(WIDE), F.lit(0)).alias("found"), F.split("t", WIDE).alias("parts"))
    # Cut before the rows are made: a text's parts are not repeated per candidate.
    near = F.expr(f"transform(found, (c, i) -> struct(c AS candidate, right(get(parts, i), {BESIDE}) AS before, left(get(parts, i + 1), {BESIDE}) AS after))")
    rows = rows.select("doc_id", "path", F.posexplode(near).alias("nth", "c"))
    return rows.select("doc_id", "nth", "c.candidate", "c.before", "c.after", F.coalesce("path", F.lit("")).alias("path"))


def dictionary(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``word, n``: the most frequent words of three to eight letters over all documents."""
    every = docs.select(F.explode(F.split(F.lower(text_of(F.col("text"))), r"[^\p{L}\p{N}]+")).alias("word"))
    every = every.where(F.length("word").between(3, 8) & F.col("word").rlike("^[a-z]+$"))
    counts = every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(words)


def letter_pairs(words: DataFrame) -> DataFrame:
    """``pair, bits``: how rare a letter follows another, at most 26 x 26 rows."""
    pairs = words.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("all"))
    joined = pairs.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a"))
    return joined.select("pair", (-F.log2(F.col("n") / F.col("all"))).alias("bits"))


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


FEATURES = (
    "length", "digits", "upper", "lower", "signs", "hex", "distinct", "turns", "bits", "covered", "named", "assigned",
    "harmless", "format", "placeholder", "before_words", "after_quote", "example_path",
    "other", "before_quote", "login", "reference", "word",
)


def features(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add :data:`FEATURES` to rows with ``candidate, before, after, path``."""
    c, before = F.col("candidate"), F.col("before")
    # Equal candidates share what the dictionary says of them.
    texts = found.select(F.col("candidate").alias("c")).distinct()
    runs = texts.select("c", F.explode(F.regexp_extract_all(F.lower("c"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    cuts = F.expr("transform(sequence(3, least(8, length(run))), k -> struct(left(run, k) AS part))")
    tails = F.expr("transform(sequence(3, least(8, length(run))), k -> struct(right(run, k) AS part))")
    parts = runs.select("c", "run", F.explode(F.array_distinct(F.concat(cuts, tails))).alias("p")).select("c", "run", "p.part")
    covered = parts.join(F.broadcast(words.select("word")), F.col("part") == F.col("word"))
    covered = covered.groupBy("c", "run").agg(F.max(F.length("part")).alias("n")).groupBy("c").agg(F.sum("n").alias("covered_n"))
    # Overlapping pairs in one pass, however long the candidate is.
    two = texts.select("c", F.explode(F.regexp_extract_all(F.lower("c"), F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("two"))
    two = two.join(F.broadcast(pairs), F.col("two") == F.col("pair"), "left")
    rare = two.groupBy("c").agg(F.avg(F.coalesce("bits", F.lit(12.0))).alias("rare"))
    about = texts.join(covered.withColumnRenamed("c", "c1"), F.col("c") == F.col("c1"), "left")
    about = about.join(rare.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2"), "left").select(F.col("c").alias("of"), "covered_n", "rare")
    joined = found.join(about, c == F.col("of")).drop("of")
    turns = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_\\-])(?=[^+/_\\-])"
    flag = lambda col, pattern: F.coalesce(col.rlike(pattern), F.lit(False)).cast("double")
    return joined.select(
        "*",
        F.length(c).cast("double").alias("length"), _share(c, "[0-9]").alias("digits"), _share(c, "[A-Z]").alias("upper"),
        _share(c, "[a-z]").alias("lower"), _share(c, r"[+/_\-]").alias("signs"), flag(c, "^[0-9a-f]+$").alias("hex"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64))).alias("distinct"),
        (F.regexp_count(c, F.lit(turns)) / F.length(c)).alias("turns"),
        F.coalesce("rare", F.lit(12.0)).alias("bits"), (F.coalesce("covered_n", F.lit(0)) / F.length(c)).alias("covered"),
        flag(before, NAMES).alias("named"), flag(before, ASSIGNED).alias("assigned"), flag(before, HARMLESS).alias("harmless"),
        flag(c, FORMATS).alias("format"), flag(c, PLACEHOLDER).alias("placeholder"),
        F.size(F.split(before, r"\s+")).cast("double").alias("before_words"), flag(F.col("after"), "^[\"']").alias("after_quote"),
        flag(F.col("path"), EXAMPLES).alias("example_path"),
        _share(c, r"[^A-Za-z0-9+/_\-]").alias("other"), flag(before, "[\"'`]$").alias("before_quote"),
        (flag(before, LOGIN) * flag(F.col("after"), "^@")).alias("login"), flag(c, REFERENCE).alias("reference"), flag(c, "^[A-Za-z]+$").alias("word"),
    )


def labelled_findings(found: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """``candidate, before, after, path, label`` from a draw of candidates of each label, with contrast rows."""
    c, before = F.col("candidate"), F.col("before")
    stands_for = c.rlike(PLACEHOLDER + "{1}[a-z_\\-]*$") | c.rlike(REFERENCE)
    sure = c.rlike(FORMATS) | (before.rlike(LOGIN) & F.col("after").rlike("^@") & ~stands_for)
    # A bare word after a colon and a space is prose.
    prose = before.rlike(r":\s+$") & c.rlike("^[A-Za-z]+$")
    named = before.rlike(ASSIGNED) & c.rlike("[a-zA-Z]") & ~stands_for & ~prose
    # All candidates are labelled before the draw, so that rare secrets are not lost among many harmless runs.
    every = found.select("candidate", "before", "after", "path", F.when(sure | named, 1.0).otherwise(0.0).alias("label")).distinct()
    every = every.withColumn("draw", F.xxhash64("candidate", "before", "after", "path"))
    of_label = [every.where(F.col("label") == v).orderBy("draw", "candidate", "before").limit(drawn) for v in (1.0, 0.0)]
    rows = settle(of_label[0].unionByName(of_label[1]), "secret-draw")
    out = ("candidate", "before", "after", "path", "label")
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod("draw", F.lit(len(values))) + 1).cast("int"))
    secrets = rows.where("label = 1")
    harmless = secrets.where(~F.col("candidate").rlike(FORMATS)).withColumn("before", F.concat(F.lit("in "), pick(BESIDE_HARMLESS)))
    harmless = harmless.withColumn("after", F.lit(" and")).withColumn("label", F.lit(0.0))
    blank = secrets.withColumn("candidate", pick(PLACEHOLDERS)).withColumn("label", F.lit(0.0))
    return rows.select(*out).unionByName(harmless.select(*out)).unionByName(blank.select(*out))


def train(findings: DataFrame, words: DataFrame, pairs: DataFrame) -> RandomForestClassificationModel | float:
    """A forest over labelled findings; if one kind is missing, the probability of all candidates."""
    rows = settle(features(findings, words, pairs).select("label", *FEATURES), "secret-training")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return 1.0 if counts.get(1.0) else 0.0
    share = F.when(F.col("label") == 1.0, F.lit(0.5 / counts[1.0])).otherwise(F.lit(0.5 / counts[0.0]))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.withColumn("weight", share * sum(counts.values())))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=11, subsamplingRate=0.8)
    return forest.fit(vectors.select("x", "label", "weight"))


def scan(docs: DataFrame, path: str | None = None, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, nth, candidate, before, after, path, probability, secret`` of every candidate."""
    found = settle(candidates(docs, path), "secret-candidates")
    words = settle(dictionary(docs), "dictionary")
    pairs = settle(letter_pairs(words), "letter-pairs")
    forest = train(labelled_findings(found) if findings is None else findings, words, pairs)
    columns = ("doc_id", "nth", "candidate", "before", "after", "path")
    if isinstance(forest, float):
        judged = found.withColumn("probability", F.lit(forest))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(found, words, pairs))
        judged = forest.transform(vectors.select(*columns, "x")).withColumn("probability", vector_to_array("probability")[1])
    return judged.select(*columns, "probability", (F.col("probability") >= threshold).alias("secret"))


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs, "source")
    return found.select(
        "doc_id", "nth", F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.length("candidate").alias("length"), F.round("probability", 9).alias("probability"), "secret",
    )
