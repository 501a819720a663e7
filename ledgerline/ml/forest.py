"""A random forest of regression trees, grown from counts instead of rows.

Trees split between at most BINS values of a feature, so they only see which
cell of a grid a row lies in, and its label. One pass counts the rows of each
cell and label; that table stops growing when all cells are taken, however many
rows there are. A bootstrap gives each row a Poisson weight, and the weights of
n equal rows add up to a Poisson weight of mean n: a tree's bootstrap is drawn
for the counts, with the distribution it has for the rows. Draws depend on the
counts and the seed alone, not on how rows are stored.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import cuts_below, uniform
from ledgerline.session import materialize, scratch

#: As in MLlib: bins of a feature, and rows whose values propose the cuts between them.
BINS, CUT_ROWS = 32, 10_000
#: A tree's task holds some 30 bytes a cell.
CELLS = 1 << 23
#: Cells are dealt to so many parts, whose draws are made together.
PARTS = 64
NODE = "tree int, id int, prediction double, impurity double, n double, total double, squares double, gain double, left int, right int, feature int, cut double"


def cut_between(values: np.ndarray, rows: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts halfway between neighbours of the sorted different values: all, or those that share the rows out evenly."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    stride, before = rows.sum() / bins, np.cumsum(rows)
    out, goal = [], stride
    for i, (less, more) in enumerate(zip(before[:-1], before[1:])):
        if abs(less - goal) < abs(more - goal):
            out.append(middle[i])
            goal += stride
    return np.array(out)


def find_cuts(rows: DataFrame, features: list[str], share: float, seed: int) -> list[np.ndarray]:
    """Each feature's cuts from this share of the rows with each of its values, rounded up or down by a hash of the value."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("value")) for i, f in enumerate(features)])
    counted = rows.select(F.inline(entries)).groupBy("i", "value").agg(F.count("*").alias("rows"))
    drawn = counted.withColumn("rows", F.floor(F.col("rows") * share + uniform("i", "value", seed=seed))).where("rows > 0")
    sample = drawn.toPandas().sort_values(["i", "value"])  # some CUT_ROWS a feature
    parts = [sample[sample["i"] == i] for i in range(len(features))]
    return [cut_between(p["value"].to_numpy(float), p["rows"].to_numpy(float)) for p in parts]


@dataclass
class Counts:
    """Rows by cell and label: cell int, label double, and the fitted and the other rows."""

    features: list[str]
    cuts: list[np.ndarray]
    table: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> "Counts":
        """Of rows with the features, ``label`` and ``fit``."""
        cell = F.lit(0)
        for f, c in zip(features, cuts):
            cell = cell * (len(c) + 1) + cuts_below(f, c)
        table = rows.select(cell.alias("cell"), "label", "fit").groupBy("cell", "label").agg(
            F.count_if("fit").alias("fitted"), F.count_if(~F.col("fit")).alias("others")
        )
        return cls(features, cuts, materialize(table, "cells"))

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    def cells(self) -> int:
        """Cells that hold rows, or all if that is few enough."""
        grid = int(np.prod(self.shape, dtype=float))
        return grid if grid <= CELLS else self.table.select("cell").distinct().count()

    def others(self) -> DataFrame:
        """The cells of the other rows: a row's features in each, and n, total and squares of the labels."""
        summed = self.table.where("others > 0").groupBy("cell").agg(
            F.sum("others").alias("n"), F.sum(F.col("others") * F.col("label")).alias("total"),
            F.sum(F.col("others") * F.col("label") * F.col("label")).alias("squares"),
        )
        place, step = {}, 1
        for f, c in reversed([*zip(self.features, self.cuts)]):
            ends = [*map(float, c), float(c[-1]) + 1.0 if len(c) else 0.0]
            at = F.floor(F.col("cell") / step).cast("int") % len(ends) + 1
            place[f] = F.element_at(F.array(*[F.lit(v) for v in ends]), at)
            step *= len(ends)
        return summed.select("n", "total", "squares", *[place[f].alias(f) for f in self.features])


def _draw(part: pd.DataFrame, trees: int, seed: int) -> pd.DataFrame:
    """A row for each tree: its cells in this part, their weight, and the weighted sums of labels and of their squares."""
    part = part.sort_values(["cell", "label"])
    label, rows = part["label"].to_numpy(float), part["fitted"].to_numpy(float)
    cells, which = np.unique(part["cell"].to_numpy(np.int32), return_inverse=True)
    out = []
    for tree in range(trees):
        weight = np.random.default_rng([seed, tree, int(part["part"].iloc[0])]).poisson(rows)
        sums = [np.bincount(which, w, len(cells)) for w in (weight, weight * label, weight * label * label)]
        some = sums[0] > 0
        out.append((tree, cells[some].tobytes(), *[s[some].tobytes() for s in sums]))
    return pd.DataFrame(out, columns=["tree", "cells", "n", "total", "squares"])


def _best(n: np.ndarray, total: np.ndarray, shape: tuple[int, ...], bins: list[np.ndarray], at: np.ndarray, nodes: int):
    """Of each node, the split that lowers the squared error most: gain, feature and last bin on the left. First of equal ones."""
    best = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
    for f, size in enumerate(shape):
        if size < 2:
            continue
        index = at * size + bins[f]
        left_n, left = (np.bincount(index, x, nodes * size).reshape(nodes, size).cumsum(axis=1) for x in (n, total))
        all_n, whole = left_n[:, -1:], left[:, -1:]
        left_n, left = left_n[:, :-1], left[:, :-1]
        right_n, right = all_n - left_n, whole - left
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = left**2 / left_n + right**2 / right_n - whole**2 / all_n
        gain = np.where((left_n >= 1) & (right_n >= 1), gain, -np.inf)
        cut = gain.argmax(axis=1)
        found = gain[np.arange(nodes), cut]
        better = found > best[0]
        for kept, new in zip(best, (found, np.full(nodes, f), cut)):
            kept[better] = new[better]
    return best


def _grow(group: pd.DataFrame, shape: tuple[int, ...], cuts: list[np.ndarray], depth: int) -> pd.DataFrame:
    """A tree's nodes, numbered from the root, each before its left and then its right part."""
    cells = np.concatenate([np.frombuffer(b, np.int32) for b in group["cells"]])
    order = np.argsort(cells, kind="stable")  # sums must not depend on the order of the parts
    cells = cells[order]
    n, total, squares = (np.concatenate([np.frombuffer(b) for b in group[c]])[order] for c in ("n", "total", "squares"))
    bins = list(np.unravel_index(cells, shape))
    levels, at, alive = [], np.zeros(len(cells), int), np.arange(len(cells))
    nodes = 1 if len(cells) else 0
    while nodes:
        sums = [np.bincount(at, x[alive], nodes) for x in (n, total, squares)]
        error = np.maximum(sums[2] - sums[1] ** 2 / sums[0], 0.0)
        gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
        if len(levels) < depth:
            gain, feature, cut = _best(n[alive], total[alive], shape, [b[alive] for b in bins], at, nodes)
            feature[gain <= 1e-12 * sums[2]] = -1  # rounding, or labels that are all equal
        child = np.full(nodes, -1)
        child[feature >= 0] = 2 * np.arange((feature >= 0).sum())
        levels.append((*sums, error / sums[0], gain / sums[0], feature, cut, child))
        keep = feature[at] >= 0
        at, alive = at[keep], alive[keep]
        value = np.zeros(len(alive), int)
        for f in range(len(shape)):
            mine = feature[at] == f
            value[mine] = bins[f][alive[mine]]
        at, nodes = child[at] + (value > cut[at]), 2 * int((feature >= 0).sum())

    rows: list[list] = []
    tree = int(group["tree"].iloc[0])

    def emit(level: int, i: int) -> int:
        sum_n, sum_y, sum_yy, impurity, gain, feature, cut, child = (x[i] for x in levels[level])
        here = len(rows)
        rows.append([tree, here, sum_y / sum_n, impurity, sum_n, sum_y, sum_yy, -1.0, -1, -1, -1, 0.0])
        if feature >= 0:
            left = emit(level + 1, child)
            right = emit(level + 1, child + 1)
            if right == here + 2 == len(rows) - 1 and rows[left][2] == rows[right][2]:  # two leaves that say the same are one
                del rows[left:]
            else:
                rows[here][7:] = [gain, left, right, feature, float(cuts[feature][cut])]
        return here

    if levels:
        emit(0, 0)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])


def grow(counts: Counts, estimator: RandomForestRegressor) -> RandomForestRegressionModel:
    """The estimator's forest from the fitted rows' counts, as MLlib's model."""
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    shape, cuts = counts.shape, counts.cuts

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        return _draw(part, trees, seed)

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        return _grow(group, shape, cuts, depth)

    drawn = counts.table.where("fitted > 0").withColumn("part", F.pmod("cell", F.lit(PARTS))).groupBy("part").applyInPandas(
        draw, "tree int, cells binary, n binary, total binary, squares binary"
    )
    nodes = materialize(drawn.groupBy("tree").applyInPandas(tree, NODE), "nodes")  # at most trees * 2**(depth + 1) rows
    return _as_model(counts.table.sparkSession, nodes, estimator, counts.features)


def _as_model(spark: SparkSession, nodes: DataFrame, estimator: RandomForestRegressor, features: list[str]) -> RandomForestRegressionModel:
    """MLlib's model with these nodes: that of two rows is saved and gets them in place of its own."""
    path = scratch(spark, "grown")
    two = spark.createDataFrame([(*map(float, range(len(features))), 0.0), (*[1.0] * len(features), 1.0)], [*features, "label"])
    estimator.fit(VectorAssembler(inputCols=features, outputCol="features").transform(two)).write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    leaf = F.col("feature") < 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("cut")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    data = nodes.select(
        F.col("tree").alias("treeID"),
        F.struct(
            "id", "prediction", "impurity", F.array("n", "total", "squares").alias("impurityStats"),
            F.col("n").cast("bigint").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
            split.alias("split"),
        ).alias("nodeData"),
    )
    assert [f.simpleString() for f in data.schema] == [f.simpleString() for f in schema], "MLlib stores forests otherwise"
    data.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
