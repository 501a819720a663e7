"""Forests grown from counts, against trees of the rows and against a try of every split."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ledgerline.functions.exprs import cuts_below
from ledgerline.ml import demand, forest


def test_cuts_below(spark):
    cuts = [-1.0, 0.0, 0.5, 2.0, 2.5]
    values = [None, float("nan"), -2.0, -1.0, -0.5, 0.0, 0.25, 2.0, 2.1, 2.5, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(cuts_below("v", cuts), cuts_below("v", [])).collect()]
    assert got == [(0 if v is None else 5 if v != v else sum(c < v for c in cuts), 0) for v in values]


def test_cuts_share_rows_out():
    few = forest.cut_between(np.array([1.0, 2.0, 4.0]), np.array([1, 1, 98.0]))
    assert list(few) == [1.5, 3.0]
    many = forest.cut_between(np.arange(1000.0), np.ones(1000))
    assert len(many) == forest.BINS - 1 and np.ptp(np.diff([0.0, *many, 999.0])) < 2
    assert len(forest.cut_between(np.array([]), np.array([]))) == 0


def test_splits_lower_the_error_most():
    """Each node of a tree against a try of every cut."""
    rng = np.random.default_rng(3)
    shape, cuts = (3, 5), [np.array([0.5, 1.5]), np.arange(4) + 0.5]
    cells = np.arange(15, dtype=np.int32)
    n, mean = rng.integers(1, 9, 15).astype(float), rng.normal(0, 3, 15)
    parts = [(0, c.tobytes(), a.tobytes(), b.tobytes(), s.tobytes()) for c, a, b, s in
             ((cells[i::2], n[i::2], (n * mean)[i::2], (n * mean**2)[i::2]) for i in (1, 0))]
    tree = forest._grow(pd.DataFrame(parts, columns=["tree", "cells", "n", "total", "squares"]), shape, cuts, 2)
    place = np.column_stack(np.unravel_index(cells, shape))

    def error(rows):
        return (n[rows] * (mean[rows] - np.average(mean[rows], weights=n[rows])) ** 2).sum() if rows.any() else 0.0

    def check(i, rows, depth):
        node = tree.iloc[i]
        assert node.prediction == pytest.approx(np.average(mean[rows], weights=n[rows])) and node.n == n[rows].sum()
        best = min(
            error(rows & (place[:, f] <= k)) + error(rows & (place[:, f] > k))
            for f in (0, 1) for k in range(shape[f] - 1) if 0 < (rows & (place[:, f] <= k)).sum() < rows.sum()
        ) if rows.sum() > 1 else None
        if depth == 2 or best is None:
            assert node.left == -1
            return
        left = rows & (place[:, int(node.feature)] < node.cut)
        assert error(left) + error(rows & ~left) == pytest.approx(best)
        assert node.gain == pytest.approx((error(rows) - best) / n[rows].sum())
        check(int(node.left), left, depth + 1)
        check(int(node.right), rows & ~left, depth + 1)

    check(0, np.ones(15, bool), 0)


def test_bootstrap_of_counts():
    """Weights have the mean and the spread of as many single draws."""
    part = pd.DataFrame({"part": 0, "cell": [1, 1, 7], "label": [1.0, 3.0, 2.0], "fitted": [400, 100, 900]})
    drawn = forest._draw(part, 300, 1)
    assert len(drawn) == 300 and all(list(np.frombuffer(c, np.int32)) == [1, 7] for c in drawn["cells"])
    n, total = (np.array([np.frombuffer(b) for b in drawn[c]]) for c in ("n", "total"))
    assert n.mean(axis=0) == pytest.approx([500, 900], rel=0.02) and n.var(axis=0) == pytest.approx([500, 900], rel=0.3)
    assert total.mean(axis=0) == pytest.approx([700, 1800], rel=0.02)


def test_forest_of_many_rows_is_grown_from_counts(spark, star, monkeypatch):
    """Many rows never get to MLlib, which stores each with a weight for every tree; the forest is as good, and holds
    for all rows wherever they are stored."""
    plain = demand.DemandModel.train(star.master, trees=20, depth=5)
    fit, given = RandomForestRegressor.fit, []

    def counted(self, rows, *args):
        given.append(rows.count())
        return fit(self, rows, *args)

    monkeypatch.setattr(RandomForestRegressor, "fit", counted)
    monkeypatch.setattr(demand, "MOST_ROWS", 1000, raising=False)
    model = demand.DemandModel.train(star.master, trees=20, depth=5)
    assert given and max(given) <= 2
    assert model.forest.getNumTrees == 20 and model.forest.getMaxDepth() == 5
    assert model.metrics["test_rows"] == plain.metrics["test_rows"]
    assert model.metrics["rmse"] == pytest.approx(plain.metrics["rmse"], rel=0.03)

    rows = demand.training_rows(star.master.withColumn("fit", demand.uniform("order_item_id", seed=42) < 0.8), model.codes, keep=("fit",))
    off = F.col("label") - F.col("prediction")
    direct = model.predict(rows).where("NOT fit").agg(
        F.sqrt(F.avg(off * off)).alias("rmse"), (1 - F.sum(off * off) / F.regr_syy("label", F.lit(1.0))).alias("r2")
    ).first()
    assert [model.metrics[k] for k in ("rmse", "r2")] == pytest.approx([direct.rmse, direct.r2])
    again = demand.DemandModel.train(star.master.repartition(3), codes=model.codes, trees=20, depth=5)
    assert [t.toDebugString.split("\n")[1:] for t in again.forest.trees] == [t.toDebugString.split("\n")[1:] for t in model.forest.trees]

    monkeypatch.setattr(forest, "CELLS", 1)  # too many cells: the rows themselves are fitted
    given.clear()
    whole = demand.DemandModel.train(star.master, trees=2, depth=2)
    assert max(given) == star.master.count() - plain.metrics["test_rows"] and whole.metrics["r2"] > 0


def test_counts_hold_all_rows(spark):
    rows = spark.createDataFrame([(float(i % 3), float(i % 5), i % 4 != 0) for i in range(60)] * 2, "a double, label double, fit boolean")
    counts = forest.Counts.of(rows, ["a"], forest.find_cuts(rows, ["a"], 1.0, 0))
    assert list(counts.cuts[0]) == [0.5, 1.5] and counts.cells() == 3
    got = {(r.cell, r.label): (r.fitted, r.others) for r in counts.table.collect()}
    want = {}
    for a, label, fit in map(tuple, rows.collect()):
        one = want.setdefault((int(a), label), [0, 0])
        one[0 if fit else 1] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    assert sorted(r.a for r in counts.others().collect()) == [0.5, 1.5, 2.5]
    assert sum(r.n for r in counts.others().collect()) == 30
