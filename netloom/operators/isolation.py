"""Isolation forest: MLlib has none.

Each tree sees a small random sample of exactly ``subsample`` rows.  Sampling costs one hash per row: a row is a
candidate of ``k`` of the ``trees`` with ``k`` drawn from the binomial law of its copies, which is nothing for nearly all rows
of a large table, and each tree keeps its smallest draws.  Only the hashes of rows are counted and only
candidates' vectors move; their number is bounded by the parameters.  The trees grow
in parallel (one small group each) and the forest is a table bounded by its parameters.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.stages import settle

_NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, max_depth: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), depth])
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = me
        if depth >= max_depth or len(rows) <= 1:
            continue
        sub = x[rows]
        low, high = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(high > low)
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes[me][2:4] = [f, cut]
        goes_left = sub[:, f] <= cut
        todo.append((rows[~goes_left], depth + 1, me, "right"))
        todo.append((rows[goes_left], depth + 1, me, "left"))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])


def _candidates(h1: int, h2: int, copies: int, trees: int, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (copy times tree) of a row that draws at least one of them, and the draws, uniform below ``share``."""
    rng = np.random.Generator(np.random.Philox(key=[(h1 ^ seed) & (2**64 - 1), h2 & (2**64 - 1)]))
    n = copies * trees
    if share >= 1.0:
        k = n
    elif n * share > 30:  # none at all is out of the question
        k = max(1, int(rng.binomial(n, share)))
    else:
        # The inverse of the binomial law without its zero.
        none, odds, k = (1.0 - share) ** n, share / (1.0 - share), 1
        left, term = rng.random() * (1.0 - none), n * odds * none
        while left > term and k < n:
            left -= term
            term *= odds * (n - k) / (k + 1)
            k += 1
    return rng.choice(n, k, replace=False, shuffle=False), rng.random(k) * share


def _draw(rows: list, trees: int, psi: int, share: float, seed: int) -> pd.DataFrame | None:
    """``tree, h1, h2, take``: the ``psi`` smallest draws of every tree, or None where a tree has too few candidates."""
    parts = []
    for h1, h2, copies in rows:
        places, draws = _candidates(h1, h2, copies, trees, share, seed)
        parts.append(pd.DataFrame({"tree": places % trees, "draw": draws, "copy": places // trees, "h1": h1, "h2": h2}))
    drawn = pd.concat(parts) if parts else pd.DataFrame(columns=["tree", "draw", "copy", "h1", "h2"])
    drawn = drawn.sort_values(["tree", "draw", "h1", "h2", "copy"], ignore_index=True)
    if (drawn.groupby("tree").size().reindex(range(trees), fill_value=0) < psi).any():
        return None
    kept = drawn[drawn.groupby("tree").cumcount() < psi]
    return kept.groupby(["tree", "h1", "h2"]).size().rename("take").reset_index()


class _ForestParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "array<double> column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "decision column, low = anomalous", TypeConverters.toString)
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "rows per tree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)


class IsolationForest(Estimator, _ForestParams):
    """Fit on benign rows only, scaled; ``inputCol`` is an array of doubles."""

    @keyword_only
    def __init__(self, *, inputCol="scaled", outputCol="iso_decision", numTrees=200, subsample=256, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol=inputCol, outputCol=outputCol, numTrees=numTrees, subsample=subsample, seed=seed)

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        trees, want, seed = (self.getOrDefault(p) for p in (self.numTrees, self.subsample, self.seed))
        col = self.getOrDefault(self.inputCol)
        spark = dataset.sparkSession
        rows = dataset.select(F.col(col).alias("x")).where(F.col("x").isNotNull())
        rows = rows.select("x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(seed), "x").alias("h2"))
        counted = settle(rows.groupBy("h1", "h2").agg(F.count("*").alias("copies")), "isolation-rows")
        n = counted.agg(F.sum("copies")).first()[0] or 0
        if n == 0:
            raise ValueError("no rows to fit on")
        psi = min(want, n)
        depth = max(1, math.ceil(math.log2(max(psi, 2))))
        # Neither partitioning nor order matters: all draws come from the hashes.  More candidates than needed are
        # drawn, so that a second round is hardly ever needed.
        share, picked = (psi + 6 * math.sqrt(psi) + 10) / n, None
        while picked is None:
            share = min(1.0, share)
            none = F.pow(F.lit(1.0 - share), F.col("copies") * trees)
            unit = F.pmod(F.xxhash64(F.lit(seed), "h2", "h1"), F.lit(1 << 52)) / float(1 << 52)
            hit = counted if share == 1.0 else counted.where(unit >= none)
            picked = _draw(hit.orderBy("h1", "h2").collect(), trees, psi, share, seed)
            share *= 2
        # At most trees * psi rows, as the sample itself.
        picks = spark.createDataFrame(picked.astype("int64"), "tree long, p1 long, p2 long, take long")
        wanted = F.broadcast(picks.select("p1", "p2").distinct())
        vectors = rows.join(wanted, (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")), "left_semi").dropDuplicates(["h1", "h2"])
        sample = picks.join(vectors, (F.col("h1") == F.col("p1")) & (F.col("h2") == F.col("p2")))
        sample = sample.select(F.col("tree").cast("int").alias("tree"), F.explode(F.array_repeat("x", F.col("take").cast("int"))).alias("x"))

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return _grow(int(key[0]), np.stack(pdf["x"].to_numpy()), depth, seed)

        nodes = sample.groupBy("tree").applyInPandas(grow, _NODES)
        # Bounded by trees * 2 * subsample rows, whatever the size of the data.
        return self._copyValues(IsolationForestModel(nodes.toPandas(), psi))


class IsolationForestModel(Model, _ForestParams):
    """``transform`` adds the decision 0.5 - s; s = 2^(-mean path / norm), 1 = anomalous."""

    def __init__(self, nodes: pd.DataFrame, psi: int):
        super().__init__()
        self.nodes, self.psi = nodes.sort_values(["tree", "node"], ignore_index=True), psi

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = self.nodes
        first = np.flatnonzero(~n["tree"].duplicated().to_numpy())
        base = np.repeat(first, np.diff(np.append(first, len(n))))
        leaf = n["feature"].to_numpy() < 0
        here = np.arange(len(n))
        parts = {
            "roots": first,
            "feature": np.where(leaf, 0, n["feature"].to_numpy()),
            "cut": n["threshold"].to_numpy(float),
            "left": np.where(leaf, here, n["left"].to_numpy() + base),
            "right": np.where(leaf, here, n["right"].to_numpy() + base),
            "length": n["depth"].to_numpy() + path_norm(n["size"].to_numpy()),
            "depth": int(n["depth"].max()),
            "norm": max(float(path_norm(self.psi)), 1e-12),
        }
        shared = dataset.sparkSession.sparkContext.broadcast(parts)

        @F.pandas_udf("double")
        def decision(x: pd.Series) -> pd.Series:
            p = shared.value
            data = np.stack(x.to_numpy())
            rows = np.arange(len(data))
            total = np.zeros(len(data))
            for root in p["roots"]:
                at = np.full(len(data), root)
                for _ in range(p["depth"]):
                    below = data[rows, p["feature"][at]] <= p["cut"][at]
                    at = np.where(below, p["left"][at], p["right"][at])
                total += p["length"][at]
            return pd.Series(0.5 - np.power(2.0, -total / len(p["roots"]) / p["norm"]))

        return dataset.withColumn(self.getOrDefault(self.outputCol), decision(F.col(self.getOrDefault(self.inputCol))))

    def save_table(self, spark, path: str) -> None:
        """Store the forest as a table; ``load_table`` reads it back."""
        table = self.nodes.assign(psi=self.psi)
        spark.createDataFrame(table).write.mode("overwrite").parquet(path)

    @staticmethod
    def load_table(spark, path: str, inputCol: str = "scaled", outputCol: str = "iso_decision") -> "IsolationForestModel":
        table = spark.read.parquet(path).toPandas()
        model = IsolationForestModel(table.drop(columns="psi"), int(table["psi"].iloc[0]))
        return model._set(inputCol=inputCol, outputCol=outputCol)
