"""Walks through many trees and rounds of k-means, against plain ways to do the same."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ledgerline.ml import anomaly, segments


def test_depths_equal_a_walk():
    rng = np.random.default_rng(5)
    sample = pd.DataFrame(rng.normal(size=(256, 5)).round(1), columns=anomaly.FEATURES)
    trees = [anomaly._grow(sample.assign(tree=t), 7) for t in range(4)]
    data = np.vstack([sample.to_numpy()[:50], [[np.nan, 0, 0, 0, 0]]])

    def walk(tree, x):
        at = tree.iloc[0]
        while at.feature >= 0:
            at = tree.iloc[int(at.left if x[int(at.feature)] <= at.cut else at.right)]
        return round(at.depth * 1e6)

    want = [sum(walk(t, x) for t in trees) / 1e6 / 4 for x in data]
    tables = [anomaly._steps({c: t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")}) for t in trees]
    assert list(anomaly._mean_depth(data, tables)) == want


def test_sums_of_nearest_centers():
    rng = np.random.default_rng(2)
    data, centers = rng.normal(size=(40, 5)), rng.normal(size=(3, 4, 5))
    centers[1, 2] = centers[1, 0]  # equally near: the first one
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in half.T], names=segments.FEATURES) for half in (data[:25], data[25:])]
    (got,) = segments._parts(iter(batches), centers)
    rows = {(r["start"], r["cluster"]): r for r in got.to_pylist()}
    for start, cluster in itertools.product(range(3), range(4)):
        near = [min(range(4), key=lambda c: (((x - centers[start, c]) ** 2).sum(), c)) == cluster for x in data]
        if not any(near):
            assert (start, cluster) not in rows
            continue
        row = rows[start, cluster]
        assert row["n"] == sum(near) and [row[f] for f in segments.FEATURES] == pytest.approx(list(data[near].sum(axis=0)))
