"""Attribution of demand predictions: exact interventional Shapley values against a whole background.

For a set S of features, v(S) is the mean prediction when the features in S come
from the explained row and the others from each background row. A forest knows
only which of its cuts a value lies between, so it is constant on the cells of a
grid. One pass counts the background rows of each cell; then v(S) depends on the
row's cell on the axes S alone, and is the product of the grid of predictions
with the background's counts on the other axes. All these tables together have
about twice as many entries as the grid, whatever the number of rows, and a row
is explained by 64 of them, where it lies: nothing is shuffled or joined.

A forest with more than GRID_CELLS cells is explained by its leaves: a leaf is
reached if the row meets its conditions on S and the background row those on the
other features. One pass counts, for every leaf, how many background rows meet
which of its conditions. Both ways are exact; no row meets another row.
"""

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.functions.exprs import cuts_below
from ledgerline.ml.demand import FEATURES, DemandModel
from ledgerline.schemas import DEMAND_LABELS
from ledgerline.session import scratch

LABELS = dict(zip(FEATURES, DEMAND_LABELS))
_N = len(FEATURES)
_SETS = 2**_N
_BINS = [f"_bin_{f}" for f in FEATURES]
#: The driver and every worker hold a few times 8 bytes a cell.
GRID_CELLS = 1 << 20
_OUT = ["base_value", "prediction", *[f"phi_{f}" for f in FEATURES]]


def _factors() -> np.ndarray:
    """Set x (base, prediction, six contributions): factors of v(S) in each."""
    out = np.zeros((_SETS, 8))
    out[0, 0] = out[_SETS - 1, 1] = 1.0
    for f in range(_N):
        out[:, 2 + f] = _weights(f)
    return out


def _weights(feature: int) -> list[float]:
    """Factor of v(S) in the feature's Shapley value, for the set with each bit mask."""
    out = []
    for mask in range(_SETS):
        has = bool(mask >> feature & 1)
        others = mask.bit_count() - has
        share = factorial(others) * factorial(_N - 1 - others) / factorial(_N)
        out.append(share if has else -share)
    return out


class _Forest:
    """Leaves of all trees as intervals of feature bins; bins are cut at the forest's own thresholds."""

    def __init__(self, model: DemandModel, spark) -> None:
        path = scratch(spark, "forest")
        model.forest.write().save(path)
        nodes = [*spark.read.parquet(f"{path}/data").select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("cut"),
        ).toPandas().itertuples(index=False)]  # at most trees * 2**(depth + 1) rows
        cuts = [sorted({n.cut for n in nodes if n.leftChild >= 0 and n.feature == f}) for f in range(_N)]
        self.cuts = [np.array(c) for c in cuts]
        place = [{v: i for i, v in enumerate(c)} for c in cuts]
        trees: dict[int, dict[int, object]] = {}
        for n in nodes:
            trees.setdefault(n.treeID, {})[n.id] = n
        self.shape = tuple(len(c) + 1 for c in cuts)  # of the grid
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []  # by tree: the leaves' first bins less one, and last bins
        self.values: list[np.ndarray] = []
        # A tree knows only some cuts; bins that it can't tell apart are one cell.
        self.cells: list[list[np.ndarray]] = []  # by tree and feature: the cell of each bin
        self.meets: list[list[np.ndarray]] = []  # by tree and feature: cell x leaf, the feature's bit if the cell is inside
        for _, tree in sorted(trees.items()):
            leaves, todo = [], [(0, [-1] * _N, [len(c) for c in cuts])]
            while todo:
                at, low, high = todo.pop()
                n = tree[at]
                if n.leftChild < 0:
                    leaves.append((n.prediction, low, high))
                    continue
                k = place[n.feature][n.cut]
                todo.append((n.leftChild, low, [min(h, k) if f == n.feature else h for f, h in enumerate(high)]))
                todo.append((n.rightChild, [max(x, k) if f == n.feature else x for f, x in enumerate(low)], high))
            self.values.append(np.array([v for v, _, _ in leaves]))
            low, high = np.array([x for _, x, _ in leaves]), np.array([x for _, _, x in leaves])
            self.boxes.append((low, high))
            known = [np.unique([place[n.feature][n.cut] for n in tree.values() if n.leftChild >= 0 and n.feature == f]).astype(int) for f in range(_N)]
            self.cells.append([np.searchsorted(k, np.arange(len(c) + 1)) for k, c in zip(known, cuts)])
            self.meets.append([
                (((b := np.append(k, len(c))[:, None]) > low[:, f]) & (b <= high[:, f])).astype(np.uint8) << f
                for f, (k, c) in enumerate(zip(known, cuts))
            ])

    def bins(self) -> list[Column]:
        """Of each feature, the number of cuts below its value."""
        return [cuts_below(f, c).alias(b) for f, b, c in zip(FEATURES, _BINS, self.cuts)]

    def masks(self, tree: int, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the different rows that a tree sees, rows x leaves: the features on which a row meets a leaf's conditions;
        and which of them each of the given rows is."""
        sizes = [len(m) for m in self.meets[tree]]
        code = np.zeros(len(bins), np.int64)
        for f, n in enumerate(sizes):
            code = code * n + self.cells[tree][f][bins[:, f]]
        seen, which = np.unique(code, return_inverse=True)
        out = np.zeros((len(seen), len(self.values[tree])), np.uint8)
        for f in reversed(range(_N)):
            out |= self.meets[tree][f][seen % sizes[f]]
            seen = seen // sizes[f]
        return out, which


def _count(batches: Iterator[pd.DataFrame], forest: _Forest) -> Iterator[pd.DataFrame]:
    """Of this task's background rows, by tree: leaf x set of conditions that are met."""
    counts = [np.zeros(len(v) * _SETS) for v in forest.values]
    for rows in batches:
        bins, n = rows[_BINS].to_numpy(np.int64), rows["n"].to_numpy(float)
        for t, total in enumerate(counts):
            leaves = len(forest.values[t])
            masks, which = forest.masks(t, bins)
            copies = np.bincount(which, n, len(masks))
            index = masks.astype(np.int64) + np.arange(leaves) * _SETS
            total += np.bincount(index.ravel(), np.repeat(copies, leaves), len(total))
    yield pd.DataFrame({"tree": range(len(counts)), "counts": [c.tobytes() for c in counts]})


def _table(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """leaf x set that a row meets x (base, prediction, six contributions): what the leaf adds to them."""
    share = counts.reshape(-1, _SETS)
    share = share / share[:1].sum()
    for f in range(_N):  # rows that meet at least the set
        for mask in range(_SETS):
            if not mask >> f & 1:
                share[:, mask] += share[:, mask | 1 << f]
    factors = _factors()
    # A set S of the row's features counts if the row meets the leaf on all of S; the others come from the background.
    added = share[:, [_SETS - 1 - s for s in range(_SETS)], None] * factors[None] * values[:, None, None]
    for f in range(_N):  # sum over the subsets of what the row meets
        for mask in range(_SETS):
            if mask >> f & 1:
                added[:, mask] += added[:, mask ^ 1 << f]
    return added


def _predictions(forest: _Forest) -> np.ndarray:
    """The forest's prediction in every cell of its grid."""
    grid = np.zeros(forest.shape)
    for values, (low, high) in zip(forest.values, forest.boxes, strict=True):
        for value, first, last in zip(values, low + 1, high + 1, strict=True):
            grid[tuple(map(slice, first, last))] += value
    return grid / len(forest.values)


def _means(grid: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """v(S) for each set S, by the cells on the axes S; `share` is the background's share of each cell."""
    out = []
    for mask in range(_SETS):
        own = tuple(f for f in range(_N) if mask >> f & 1)
        others = tuple(f for f in range(_N) if not mask >> f & 1)
        out.append((grid * share.sum(axis=own, keepdims=True)).sum(axis=others))
    return out


class Explainer:
    """What attribution needs of a model and a background: made by one pass over the background, then used for any rows.

    ``background`` holds encoded features, as many rows as there are. Without background rows there is no value to start
    from, and all results are NaN.
    """

    def __init__(self, model: DemandModel, background: DataFrame) -> None:
        self.forest = _Forest(model, background.sparkSession)
        known = background.select(*self.forest.bins()).groupBy(*_BINS).agg(F.count("*").alias("n"))
        by_grid = np.prod(self.forest.shape, dtype=float) <= GRID_CELLS
        self._values = self._by_grid(known) if by_grid else self._by_leaves(known)
        self._joined = not by_grid

    def _by_grid(self, known: DataFrame):
        """A function from rows of bins to their results, of the cells' counts."""
        shape, factors = self.forest.shape, _factors()
        counted = known.toPandas()  # a row for each cell at most
        counts = np.zeros(shape)
        counts[tuple(counted[_BINS].to_numpy(np.int64).T)] = counted["n"]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = counts / counts.sum()
        means = known.sparkSession.sparkContext.broadcast(_means(_predictions(self.forest), share))

        def values(bins: np.ndarray) -> np.ndarray:
            v = np.empty((len(bins), _SETS))
            for mask, table in enumerate(means.value):
                v[:, mask] = table[tuple(bins[:, f] for f in range(_N) if mask >> f & 1)]
            return v @ factors

        return values

    def _by_leaves(self, known: DataFrame):
        """The same of the leaves' counts."""
        forest, context = self.forest, known.sparkSession.sparkContext
        shipped = context.broadcast(forest)  # size fixed by trees and depth, as is the table below
        by_task = known.mapInPandas(lambda batches: _count(batches, shipped.value), "tree int, counts binary")

        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(c) for c in group["counts"])
            return pd.DataFrame({"tree": group["tree"][:1], "counts": [total.tobytes()]})

        counted = by_task.groupBy("tree").applyInPandas(add, "tree int, counts binary").collect()  # a row for each tree
        with np.errstate(invalid="ignore", divide="ignore"):
            tables = {r.tree: _table(forest.values[r.tree], np.frombuffer(r.counts)) for r in counted}
        nothing = [np.full((len(v), _SETS, 8), np.nan) for v in forest.values]
        tables = context.broadcast([tables.get(t, nothing[t]) for t in range(len(forest.values))])

        def values(bins: np.ndarray) -> np.ndarray:
            sums = np.zeros((len(bins), 8))
            for t, table in enumerate(tables.value):
                masks, which = shipped.value.masks(t, bins)
                added = np.zeros((len(masks), 8))
                for leaf, mask in zip(table, np.ascontiguousarray(masks.T)):  # a leaf's part of the table is small
                    added += leaf.take(mask, axis=0)
                sums += added[which]
            return sums / len(tables.value)

        return values

    def explain(self, rows: DataFrame) -> DataFrame:
        """``rows``, encoded features and any columns beside them, with base_value, prediction and six contributions."""
        values = self._values
        binned = rows.select("*", *self.forest.bins())
        # A walk over all leaves is worth a join; then rows with the same bins are explained once.
        todo = binned.select(*_BINS).distinct() if self._joined else binned
        keep = len(todo.columns) if self._joined else len(rows.columns)
        schema = StructType([*todo.schema.fields[:keep], *[StructField(c, DoubleType()) for c in _OUT]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = np.column_stack([batch.column(batch.num_columns - _N + f).to_numpy() for f in range(_N)])
                found = values(bins)
                columns = [*batch.columns[:keep], *[pa.array(found[:, k]) for k in range(len(_OUT))]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        explained = todo.mapInArrow(run, schema)
        return binned.join(explained, _BINS).select(*rows.columns, *_OUT) if self._joined else explained


def explain(model: DemandModel, rows: DataFrame, background: DataFrame) -> DataFrame:
    """base_value, prediction and six contributions for each distinct feature row."""
    return Explainer(model, background).explain(rows.select(*FEATURES).distinct())


def contributions(explained: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per explained row and feature, with the feature's value."""
    entries = [
        F.struct(
            F.lit(LABELS[f]).alias("feature"),
            F.col(f).alias("feature_value"),
            F.col(f"phi_{f}").alias("contribution"),
        )
        for f in FEATURES
    ]
    return explained.select(*keep, F.inline(F.array(*entries)))


def draw(rows: DataFrame, n: int | None) -> DataFrame:
    """All rows, or n of them by a hash of their values, the same ones wherever they are stored."""
    return rows if n is None else rows.orderBy(F.md5(F.concat_ws("|", *rows.columns)), *rows.columns).limit(n)


def importance(model: DemandModel, features: DataFrame, background: DataFrame, n: int | None = None) -> DataFrame:
    """Mean absolute contribution of each feature over all rows (or n of them), smallest first."""
    explained = Explainer(model, background).explain(draw(features.select(*FEATURES), n))
    sums = explained.agg(*[F.avg(F.abs(f"phi_{f}")).alias(f) for f in FEATURES])
    entries = [F.struct(F.lit(LABELS[f]).alias("feature"), F.col(f).alias("importance")) for f in FEATURES]
    return sums.select(F.inline(F.array(*entries))).where("importance IS NOT NULL").orderBy("importance", "feature")


def beeswarm(model: DemandModel, items: DataFrame, background: DataFrame, n: int | None = None) -> DataFrame:
    """Feature, its value and its contribution for each item (or n of them); ``items`` has order_item_id and features."""
    return contributions(Explainer(model, background).explain(draw(items, n)), "order_item_id")
