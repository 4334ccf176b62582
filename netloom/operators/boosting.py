"""Boosted trees with second-order gains, L1/L2 terms, row and column draws, for two or more classes.

MLlib's boosting has none of these.  Features are cut into at most ``bins`` parts once.  A round grows one tree per class (one
in all for two classes), level by level: each task adds its rows' gradients and hessians to histograms
over (tree, node, feature, bin), one grouped aggregation sums them, one small group per node finds its best split, and
the driver sees a row per node.  So a level costs one pass over the binned rows and a shuffle of histograms, whose size depends
on the parameters alone.  Margins are written every ``settle_every`` rounds; between, a pass applies the few trees since.

Rows: a missing value (null or NaN) goes to the side that gains more; labels are 0 to K - 1; rows with a null label are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.stages import settle

_HIST = "tree int, node int, feature int, g array<double>, h array<double>"
_SPLIT = "tree int, node int, feature int, bin int, missing_left boolean, gain double, g double, h double"


@dataclass(frozen=True)
class BoostParams:
    """The defaults are those of the multi-class model; ``columns`` is the share of features each tree may use."""

    rounds: int = 300
    depth: int = 6
    eta: float = 0.05
    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    min_child: float = 1.0
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = 42
    settle_every: int = 8


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by row and tree; one margin column means two classes."""
    if margins.shape[1] == 1:
        p, target = 1.0 / (1.0 + np.exp(-margins)), y[:, None].astype(float)
        g, h = p - target, p * (1.0 - p)
    else:
        p = softmax(margins)
        g, h = p - (np.arange(margins.shape[1]) == y[:, None]), 2.0 * p * (1.0 - p)
    return g * weight[:, None], np.maximum(h, 1e-16) * weight[:, None]


def shrunk(g: np.ndarray | float, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, p: BoostParams) -> tuple[int, int, bool, float]:
    """``feature, bin, missing_left, gain`` of a node's histograms (feature x bin, bin 0 for missing values); feature -1 for none.

    Ties go to the smaller feature, then the smaller bin, then missing values on the right.
    """
    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return shrunk(a, p.l1) ** 2 / (b + p.l2)

    total_g, total_h = g[0].sum(), h[0].sum()
    best = (-1, -1, False, 1e-12)
    left_g, left_h = g[:, 1:].cumsum(axis=1)[:, :-1], h[:, 1:].cumsum(axis=1)[:, :-1]
    gains = []
    for side in (0.0, 1.0):
        a, b = left_g + side * g[:, :1], left_h + side * h[:, :1]
        ok = (b >= p.min_child) & (total_h - b >= p.min_child) & allowed[:, None]
        gain = 0.5 * (score(a, b) + score(total_g - a, total_h - b) - score(total_g, total_h)) - p.gamma
        gains.append(np.where(ok, gain, -np.inf))
    both = np.round(np.stack(gains, axis=2), 10)  # sums in another order must not decide a tie
    if both.size:
        f, k, side = np.unravel_index(int(both.argmax()), both.shape)
        if both[f, k, side] > best[3]:
            best = (int(f), int(k) + 1, bool(side), float(both[f, k, side]))
    return best


class Tree:
    """Nodes in arrays; a leaf has feature -1.  Bins up to ``bin`` go left."""

    def __init__(self) -> None:
        self.feature, self.bin, self.missing_left, self.left, self.right, self.value = [-1], [0], [False], [0], [0], [0.0]

    def split(self, node: int, feature: int, bin_: int, missing_left: bool) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node], self.right[node] = children
        for _ in children:
            for values, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                values.append(empty)
        return children

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of binned features."""
        feature, cut, missing = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            value = bins[rows, np.maximum(feature[at], 0)]
            goes_left = np.where(value == 0, missing[at], value <= cut[at])
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)


def drawn_columns(tree: int, features: int, p: BoostParams) -> np.ndarray:
    """Which features the tree of this number may use."""
    n = max(1, round(p.columns * features))
    allowed = np.zeros(features, bool)
    allowed[np.random.default_rng([p.seed, tree]).permutation(features)[:n]] = True
    return allowed


def drawn_rows(row: np.ndarray, round_: int, p: BoostParams) -> np.ndarray:
    """Which rows a round uses, by a hash of their number."""
    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) + np.uint64(p.seed * 0x9E3779B9 + round_ * 0x85EBCA6B + 1)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2**53 < p.rows


def cut_points(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """At most ``bins - 1`` cuts per feature, from a quantile sketch of a hundredth of a bin's share."""
    shares = [k / bins for k in range(1, bins)]
    quoted = [F.when(~F.isnan(c), c) for c in (F.col(f"`{c}`").cast("double") for c in cols)]
    named = df.select(*(c.alias(f"f{k}") for k, c in enumerate(quoted)))
    row = named.agg(*(F.percentile_approx(f"f{k}", shares, 100 * bins).alias(f"f{k}") for k in range(len(cols)))).first()
    tops = named.agg(*(F.max(f"f{k}").alias(f"f{k}") for k in range(len(cols)))).first()
    return [sorted({v for v in (row[k] or []) if v < tops[k]}) for k in range(len(cols))]


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin 0 for missing values, else 1 and up: a value up to the k-th cut has bin k."""
    out = np.zeros(values.shape, np.int16)
    for k, own in enumerate(cuts):
        out[:, k] = np.where(np.isnan(values[:, k]), 0, np.searchsorted(np.array(own), values[:, k], side="left") + 1)
    return out


@dataclass
class BoostedModel:
    """``transform`` adds an array of class probabilities and the most probable class."""

    cols: list[str]
    classes: int
    cuts: list[list[float]]
    trees: list[Tree]  # round by round, class by class
    params: BoostParams

    @property
    def width(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def margins(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.zeros((len(bins), self.width))
        for k, tree in enumerate(self.trees if trees is None else trees):
            out[:, k % self.width] += np.array(tree.value)[tree.nodes(bins)]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        m = self.margins(binned(values, self.cuts))
        if self.width == 1:
            p = 1.0 / (1.0 + np.exp(-m))
            return np.hstack([1.0 - p, p])
        return softmax(m)

    def transform(self, df: DataFrame, probability: str = "boost_vec", prediction: str = "boost_pred") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)  # bounded by rounds, classes and depth

        @F.pandas_udf("array<double>")
        def score(*columns: pd.Series) -> pd.Series:
            values = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], axis=1)
            return pd.Series(list(shared.value.probabilities(values)))

        out = df.withColumn(probability, score(*(F.col(f"`{c}`").cast("double") for c in self.cols)))
        best = F.array_position(F.col(probability), F.array_max(probability)) - 1
        return out.withColumn(prediction, best.cast("double"))

    def importance(self) -> list[float]:
        """Share of splits by feature."""
        n = np.zeros(len(self.cols))
        for tree in self.trees:
            np.add.at(n, [f for f in tree.feature if f >= 0], 1)
        return (n / max(1.0, n.sum())).tolist()

    def save_table(self, spark: SparkSession, path: str) -> None:
        plain = {"cols": self.cols, "classes": self.classes, "cuts": self.cuts, "params": asdict(self.params), "trees": [vars(t) for t in self.trees]}
        spark.createDataFrame([(json.dumps(plain),)], "model string").write.mode("overwrite").parquet(path)

    @classmethod
    def load_table(cls, spark: SparkSession, path: str) -> BoostedModel:
        raw = json.loads(spark.read.parquet(path).first().model)
        trees = []
        for values in raw["trees"]:
            trees.append(Tree())
            vars(trees[-1]).update(values)
        return cls(raw["cols"], raw["classes"], raw["cuts"], trees, BoostParams(**raw["params"]))


def _state(df: DataFrame, cols: list[str], label: str, weight: Column, cuts: list[list[float]], width: int) -> DataFrame:
    """``row, y, weight, bins, margins``: the rows as every pass reads them."""
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in cols)).alias("x")
    rows = df.where(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), weight.cast("double").alias("weight"), values)
    features = len(cols)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, features)
            bins = binned(flat, cuts)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([b.tobytes() for b in bins], pa.binary()),
                pa.array([bytes(8 * width)] * batch.num_rows, pa.binary()),
            ], ["row", "y", "weight", "bins", "margins"])

    return settle(rows.mapInArrow(batches, "row long, y int, weight double, bins binary, margins binary"), "boost-rows")


def _unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.int16).reshape(n, -1)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), float).reshape(n, width)
    return batch.column("row").to_numpy(), batch.column("y").to_numpy(), batch.column("weight").to_numpy(), bins, margins


def _histograms(state: DataFrame, model: BoostedModel, waiting: list[Tree], growing: list[Tree], open_: list[set[int]], round_: int) -> DataFrame:
    """Sums of gradients and hessians of the open nodes; ``waiting`` are the trees that the margins lack."""
    shared = state.sparkSession.sparkContext.broadcast((model, waiting, growing, open_))
    size = model.params.bins + 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, since, trees, nodes = shared.value
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in it:
            row, y, weight, bins, margins = _unpacked(batch, own.width)
            used = drawn_rows(row, round_, own.params)
            if not used.any():
                continue
            y, weight, bins, margins = y[used], weight[used], bins[used], margins[used]
            g, h = gradients(margins + own.margins(bins, since), y, weight)
            features = bins.shape[1]
            place = bins + np.arange(features, dtype=np.int64) * size
            for k, tree in enumerate(trees):
                if not nodes[k]:
                    continue
                at = tree.nodes(bins)
                for node in nodes[k]:
                    mine = at == node
                    if mine.any():
                        where, n = place[mine].ravel(), features * size
                        sums = held.setdefault((k, node), np.zeros((2, n)))
                        sums[0] += np.bincount(where, np.repeat(g[mine, k], features), n)
                        sums[1] += np.bincount(where, np.repeat(h[mine, k], features), n)
        for (k, node), sums in held.items():
            features = sums.shape[1] // size
            g, h = sums.reshape(2, features, size)
            yield pa.RecordBatch.from_arrays([
                pa.array([k] * features, pa.int32()), pa.array([node] * features, pa.int32()), pa.array(range(features), pa.int32()),
                pa.array(list(g), pa.list_(pa.float64())), pa.array(list(h), pa.list_(pa.float64())),
            ], ["tree", "node", "feature", "g", "h"])

    parts = state.mapInArrow(batches, _HIST)
    # One value per bin is summed on the map side too; the bins of a feature stay together for the split.
    flat = parts.select("tree", "node", "feature", F.posexplode(F.arrays_zip("g", "h")).alias("bin", "v"))
    return flat.where("v.h > 0").groupBy("tree", "node", "feature", "bin").agg(F.sum("v.g").alias("g"), F.sum("v.h").alias("h"))


def _splits(hist: DataFrame, model: BoostedModel, round_: int) -> list:
    """The best split of every open node, with its sums."""
    p, features, size, width = model.params, len(model.cols), model.params.bins + 1, model.width

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g, h = np.zeros((2, features, size))
        g[pdf["feature"], pdf["bin"]], h[pdf["feature"], pdf["bin"]] = pdf["g"], pdf["h"]
        allowed = drawn_columns(round_ * width + int(key[0]), features, p)
        feature, cut, missing_left, gain = best_split(g, h, allowed, p)
        return pd.DataFrame([(int(key[0]), int(key[1]), feature, cut, missing_left, gain, g[0].sum(), h[0].sum())], columns=[c.split()[0] for c in _SPLIT.split(", ")])

    return hist.groupBy("tree", "node").applyInPandas(solve, _SPLIT).collect()


def _leaf(g: float, h: float, p: BoostParams) -> float:
    return float(-p.eta * shrunk(g, p.l1) / (h + p.l2))


def train_boosted(
    df: DataFrame, cols: list[str], label: str, classes: int, params: BoostParams = BoostParams(), weight: Column | None = None
) -> BoostedModel:
    """Fit on the numeric columns ``cols``; ``weight`` is a weight per row (1 by default)."""
    if classes < 2:
        raise ValueError("at least two classes are needed")
    cols, spark = list(cols), df.sparkSession
    model = BoostedModel(cols, classes, cut_points(df, cols, params.bins), [], params)
    state = _state(df, cols, label, F.lit(1.0) if weight is None else weight, model.cuts, model.width)
    waiting: list[Tree] = []
    for round_ in range(params.rounds):
        growing = [Tree() for _ in range(model.width)]
        open_ = [{0} for _ in growing]
        for level in range(params.depth + 1):
            if not any(open_):
                break
            found = _splits(_histograms(state, model, waiting, growing, open_, round_), model, round_)
            open_ = [set() for _ in growing]
            for s in sorted(found, key=lambda s: (s.tree, s.node)):
                tree = growing[s.tree]
                tree.value[s.node] = _leaf(s.g, s.h, params)
                if level < params.depth and s.feature >= 0:
                    open_[s.tree].update(tree.split(s.node, s.feature, s.bin, s.missing_left))
        model.trees += growing
        waiting += growing
        if len(waiting) >= params.settle_every * model.width and round_ + 1 < params.rounds:
            state, waiting = _with_margins(spark, state, model, waiting), []
    return model


def _with_margins(spark: SparkSession, state: DataFrame, model: BoostedModel, waiting: list[Tree]) -> DataFrame:
    shared = spark.sparkContext.broadcast((model, waiting))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, since = shared.value
        for batch in it:
            _, _, _, bins, margins = _unpacked(batch, own.width)
            new = margins + own.margins(bins, since)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([m.tobytes() for m in new], pa.binary())], batch.schema.names)

    return settle(state.mapInArrow(batches, "row long, y int, weight double, bins binary, margins binary"), "boost-rows")
