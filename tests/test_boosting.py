"""Second-order boosting against a trainer written out row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import models
from netloom.operators.boosting import BoostedModel, BoostParams, drawn_columns, drawn_rows, train_boosted

COLS = ["a", "b c", "d"]


def made(n, classes, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, d = r.gauss(0, 1), r.choice([0.0, 1.0, 2.0, 7.0]), r.random()
        y = int(min(classes - 1, max(0, round(a + b / 3 + r.gauss(0, 0.3)))))
        rows.append((None if r.random() < 0.1 else a, math.nan if r.random() < 0.1 else b, d, y, r.choice([0.5, 1.0, 3.0])))
    return rows


def plain_trainer(x, y, w, row, cuts, classes, p):
    """Nested lists and loops; returns the margins of all rows after every round."""
    n, width = len(x), 1 if classes == 2 else classes
    where = [[0 if v is None or math.isnan(v) else 1 + sum(v > c for c in cuts[f]) for f, v in enumerate(r)] for r in x]
    margins, history = [[0.0] * width for _ in range(n)], []
    soft = lambda g: math.copysign(max(abs(g) - p.l1, 0.0), g)
    score = lambda g, h: soft(g) ** 2 / (h + p.l2)
    for t in range(p.rounds):
        used = [i for i in range(n) if drawn_rows(np.array([row[i]]), t, p)[0]]
        grad, hess = [[0.0] * width for _ in range(n)], [[0.0] * width for _ in range(n)]
        for i in range(n):
            if width == 1:
                q = 1 / (1 + math.exp(-margins[i][0]))
                grad[i][0], hess[i][0] = w[i] * (q - y[i]), w[i] * max(q * (1 - q), 1e-16)
            else:
                e = [math.exp(m - max(margins[i])) for m in margins[i]]
                for k in range(width):
                    q = e[k] / sum(e)
                    grad[i][k], hess[i][k] = w[i] * (q - (y[i] == k)), w[i] * max(2 * q * (1 - q), 1e-16)
        for k in range(width):
            allowed = drawn_columns(t * width + k, len(cuts), p)

            def grow(members, everyone, level):
                g, h = sum(grad[i][k] for i in members), sum(hess[i][k] for i in members)
                best = (1e-12, None)
                if level < p.depth:
                    for f in range(len(cuts)):
                        for cut in range(1, p.bins + 1):
                            for missing_left in (False, True):
                                left = [i for i in members if (missing_left if where[i][f] == 0 else where[i][f] <= cut)]
                                gl, hl = sum(grad[i][k] for i in left), sum(hess[i][k] for i in left)
                                if not allowed[f] or hl < p.min_child or h - hl < p.min_child:
                                    continue
                                gain = round(0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - p.gamma, 10)
                                if gain > best[0]:
                                    best = (gain, (f, cut, missing_left))
                if best[1] is None:
                    for i in everyone:
                        margins[i][k] += -p.eta * soft(g) / (h + p.l2)
                    return
                f, cut, missing_left = best[1]
                side = lambda i: missing_left if where[i][f] == 0 else where[i][f] <= cut
                for s in (True, False):
                    grow([i for i in members if side(i) == s], [i for i in everyone if side(i) == s], level + 1)

            grow(used, list(range(n)), 0)
        history.append([list(m) for m in margins])
    return history


@pytest.mark.parametrize("classes,over", [
    (3, {}), (2, {"l1": 0.7, "l2": 3.0, "gamma": 0.05}), (4, {"rows": 1.0, "columns": 1.0, "min_child": 4.0, "settle_every": 1}),
])
def test_equals_plain_trainer(spark, classes, over):
    p = BoostParams(**{"rounds": 4, "depth": 3, "eta": 0.4, "bins": 6, "rows": 0.7, "columns": 0.67, "settle_every": 3, **over})
    rows = made(160, classes)
    df = spark.createDataFrame(rows, "a double, `b c` double, d double, y int, w double").coalesce(1)
    model = train_boosted(df, COLS, "y", classes, p, F.col("w"))
    assert all(len(c) < p.bins for c in model.cuts) and len(model.trees) == 4 * model.width
    x, y, w = [r[:3] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
    want = plain_trainer(x, y, w, list(range(len(rows))), model.cuts, classes, p)[-1]
    values = np.array([[np.nan if v is None else v for v in r] for r in x], float)
    from netloom.operators.boosting import binned

    got = model.margins(binned(values, model.cuts))
    assert np.allclose(got, want, atol=1e-9)


def test_partitions_do_not_matter_and_tables_load(spark, tmp_path):
    p = BoostParams(rounds=3, depth=3, eta=0.3, rows=1.0, columns=0.67, bins=8)
    df = spark.createDataFrame(made(300, 3, 5), "a double, `b c` double, d double, y int, w double")
    models_ = [train_boosted(df.repartition(n), COLS, "y", 3, p) for n in (1, 6)]
    assert [vars(t)["feature"] for t in models_[0].trees] == [vars(t)["feature"] for t in models_[1].trees]
    models_[0].save_table(spark, str(tmp_path / "m"))
    again = BoostedModel.load_table(spark, str(tmp_path / "m"))
    a, b = (m.transform(df).select("boost_vec", "boost_pred").collect() for m in (models_[0], again))
    assert a == b and all(abs(sum(r.boost_vec) - 1) < 1e-12 for r in a)
    right = models_[0].transform(df).where("boost_pred = y").count()
    assert right > 0.75 * 300 and abs(sum(again.importance()) - 1) < 1e-12
    nothing = models_[0].transform(spark.createDataFrame([(None, None, None)], "a double, `b c` double, d double")).first()
    assert len(nothing.boost_vec) == 3


def test_class_models_score_through_one_door(spark):
    df = spark.createDataFrame(made(240, 3, 7), "a double, `b c` double, d double, y int, w double").fillna(0.0)
    df = models.assemble(df.withColumnRenamed("y", "label_enc"), COLS)
    for kind, over in (("ovr", {"maxIter": 3, "maxDepth": 3}), ("softmax", {"rounds": 3, "depth": 3, "eta": 0.5}), ("forest", {"numTrees": 5})):
        model = models.train_multiclass(df, kind=kind, cols=COLS, **over)
        rows = models.with_class(df, model, ["x", "y", "z"]).select("label_enc", "class_name", "class_confidence").collect()
        right = sum("xyz"[r.label_enc] == r.class_name for r in rows)
        assert right > 0.7 * len(rows) and all(1 / 3 - 1e-9 <= r.class_confidence <= 1 for r in rows), kind
    with pytest.raises(ValueError):
        models.train_multiclass(df, kind="other")
