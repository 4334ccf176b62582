"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed terms: each word and its beginnings of four to six letters
(so inflected and glued forms share terms).  Training has two steps:

1. How many toxic and other training rows hold each of the ``BINS`` term hashes is counted; the
   ``TERMS`` hashes most associated with the label (chi-square, at least ``LEAST`` rows and
   ``CHI2``) become features.
2. The machine, bias + linear weights + pairwise interactions as inner products of factors,
   is fitted by AdaGrad on the log loss over the rows' features, a few numbers each.

Both use the same at most ``ROWS`` labelled rows, drawn by a hash of the id from all labels.
This bound is the only sample; it lets the labels be broadcast to the documents, so no text is
shuffled.

The interactions let two terms mean more together than apart (an insult beside the mention of a
group).  Scoring reads whole texts in Arrow batches; the model (at most ``TERMS`` rows of
``1 + FACTORS`` numbers) travels with the tasks.  Only the text is an input of a score.

Rows: null, empty and wordless texts score as the bias; null ids and repeated rows are
scored like others; labels without a value or without a document are ignored, an id with
several labels is toxic if one says so.  Without a labelled row of each kind the score is
the share of toxic labels (0 without labels).  Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.stages import settle

BINS = 1 << 18
TERMS = 4096
LEAST = 4
CHI2 = 16.0
ROWS = 30_000
FACTORS = 8
FOLDS = 5
_WORD = re.compile(r"\w+")
_CACHE = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null id is not held out, and never labelled."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def term_bins(word: str, bins: int = BINS) -> tuple[int, ...]:
    terms = {word, *("^" + word[:k] for k in (4, 5, 6) if len(word) >= k)}
    return tuple(sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % bins for t in terms}))


class Terms:
    """The bins of a text, with the bins of recent words remembered.

    ``known`` maps the bins that count to their number; without it, all bins count.
    """

    def __init__(self, known: dict[int, int] | None = None, bins: int = BINS):
        self.known, self.bins = known, bins
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        seen, known = self.seen, self.known
        for word in set(_WORD.findall((text or "").lower())):
            found = seen.get(word)
            if found is None:
                found = term_bins(word, self.bins)
                if known is not None:
                    found = tuple(known[b] for b in found if b in known)
                if len(seen) >= _CACHE:
                    seen.clear()
                seen[word] = found
            if found:
                out.update(found)
        return sorted(out)


@dataclass
class Machine:
    """A fitted factorization machine over numbered bins."""

    known: dict[int, int] = field(default_factory=dict)
    bias: float = -20.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def margin(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.array([t for r in rows for t in r], np.int64)
        of = np.repeat(np.arange(len(rows)), sizes)
        linear = np.bincount(of, self.linear[flat], len(rows))
        sums, squares = np.zeros((len(rows), self.factors.shape[1])), np.zeros(len(rows))
        if len(flat):
            v = self.factors[flat]
            has = sizes > 0
            starts = np.concatenate([[0], sizes.cumsum()[:-1]])[has]
            sums[has] = np.add.reduceat(v, starts, axis=0)
            squares = np.bincount(of, (v * v).sum(axis=1), len(rows))
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(rows), -30.0, 30.0)))


def fit(rows: list[list[int]], labels: np.ndarray, known: dict[int, int], factors: int = FACTORS,
        epochs: int = 20, batch: int = 256, rate: float = 0.1, penalty: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the log loss; rows are sets of feature numbers."""
    rng = np.random.default_rng(seed)
    share = min(max(float(labels.mean()), 1e-6), 1 - 1e-6)
    model = Machine(known, float(np.log(share / (1 - share))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)))
    g_bias, g_linear, g_factors = 1e-8, np.full(len(known), 1e-8), np.full((len(known), factors), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = [rows[k] for k in order[at : at + batch]]
            error = model.scores(own) - labels[order[at : at + batch]]
            sizes = np.array([len(r) for r in own], np.int64)
            flat = np.array([t for r in own for t in r], np.int64)
            step = error.mean()
            g_bias += step * step
            model.bias -= rate * step / np.sqrt(g_bias)
            if not len(flat):
                continue
            of = np.repeat(np.arange(len(own)), sizes)
            v = model.factors[flat]
            sums = np.zeros((len(own), factors))
            np.add.at(sums, of, v)
            used, place = np.unique(flat, return_inverse=True)
            e = error[of] / len(own)
            d_linear = np.bincount(place, e, len(used)) + penalty * model.linear[used]
            d_factors = np.zeros((len(used), factors))
            np.add.at(d_factors, place, e[:, None] * (sums[of] - v))
            d_factors += penalty * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            model.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
    return model


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id, text, toxic`` of the training rows, from at most ``rows`` labelled ids."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("of"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("of")))
    drawn = marks.orderBy(F.xxhash64("of"), "of").limit(rows)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(drawn), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic")


def associated(train: DataFrame, terms: int = TERMS, bins: int = BINS) -> tuple[dict[int, int], int, int]:
    """The chosen bins, numbered, and how many toxic and other rows there are."""

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Terms(bins=bins), np.zeros((2, bins + 1), np.int64)
        for batch in it:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                held = own.of(text.as_py())
                total[int(toxic.as_py() > 0), held + [bins]] += 1
        found = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[1, found]), pa.array(total[0, found])], ["bin", "toxic", "other"])

    per = train.select("text", "toxic").mapInArrow(counts, "bin long, toxic long, other long")
    per = settle(per.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "term-counts")
    whole = per.where(F.col("bin") == bins).first()
    if whole is None:
        return {}, 0, 0
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    c, d = whole.toxic - a, whole.other - b
    all_rows = float(whole.toxic + whole.other)
    chi2 = all_rows * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d) + F.lit(1e-9))
    best = per.where((F.col("bin") < bins) & (a + b >= LEAST)).withColumn("chi2", chi2).where(F.col("chi2") >= CHI2)
    rows = best.orderBy(F.desc("chi2"), "bin").limit(terms).collect()
    return {r.bin: k for k, r in enumerate(rows)}, whole.toxic, whole.other


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS, bins: int = BINS) -> Machine:
    own = settle(labelled(docs, labels, rows), "toxicity-sample")
    known, toxic, other = associated(own, terms, bins)
    if not toxic or not other:
        return Machine(bias=20.0 if toxic else -20.0)

    def reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Terms(known, bins)
        for batch in it:
            held = pa.array([use.of(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), held, batch.column(2)], ["doc_id", "held", "toxic"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sample = own.select("doc_id", "text", "toxic").mapInArrow(reduce, f"doc_id {id_type}, held array<int>, toxic int")
    # An id of several documents has several rows; the bound holds for them too.
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "held").limit(rows).collect()
    return fit([r.held for r in sample], np.array([float(r.toxic > 0) for r in sample]), known)


def score(docs: DataFrame, model: Machine, bins: int = BINS) -> DataFrame:
    """``doc_id, score``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Terms(model.known, bins)
        for batch in it:
            found = model.scores([use.of(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(batches, f"doc_id {id_type}, score double")


def drop_toxic(docs: DataFrame, model: Machine, threshold: float = 0.5, bins: int = BINS) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""

    @F.pandas_udf("boolean")
    def below(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use = Terms(model.known, bins)
        for part in texts:
            yield pd.Series(model.scores([use.of(t) for t in part]) < threshold)

    return docs.where(below(F.col("text").cast("string")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, train(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
