"""Leakage anomalies by isolation forest (Liu, Ting and Zhou, 2008).

Each tree needs only a few hundred sampled rows, so trees are grown in parallel,
one small group per tree. Scoring touches every row: the forest is a few
thousand numbers, shipped to the tasks, and rows stream past it in Arrow batches.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import exact_quantiles
from ledgerline.functions.exprs import uniform
from ledgerline.ml.saved import load_or_train
from ledgerline.schemas import ANOMALY_FEATURES as FEATURES
from ledgerline.session import materialize

NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"
TREES, ROWS_PER_TREE, CONTAMINATION, SEED = 100, 256, 0.06, 42
EULER_GAMMA = 0.5772156649015329


def expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _features(m: DataFrame, *keep: str) -> DataFrame:
    return m.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def sample_for_trees(x: DataFrame, rows: int, trees: int, per_tree: int, seed: int) -> DataFrame:
    """A sample of ``per_tree`` rows for each tree, in one pass.

    All draws are hashes of the item's key and values, so the sample does not depend on how rows are stored. Most rows of a large
    fact drop out on one draw at once; for the rest, a draw for each tree decides whether that tree sees the row. About
    twice what is needed is drawn and the rows with the lowest draws are kept, so a tree's group is small by construction.
    """
    keep = 1.0 if rows <= 2 * per_tree else 2.0 * per_tree / rows
    thin = min(1.0, trees * keep)

    def ticket(tree: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), tree.cast("string"), "key")
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))

    tickets = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), ticket(t).alias("ticket"))
    )
    best = Window.partitionBy("tree").orderBy("ticket", *FEATURES)
    millionths = [F.floor(F.col(c) * 1e6 + 0.5).cast("string") for c in FEATURES]  # item keys may repeat
    return (
        x.withColumn("key", F.concat_ws("|", F.coalesce("order_item_id", F.lit("~")), *millionths))
        .filter(uniform("key", seed=seed) < thin)
        .select(*FEATURES, F.inline(F.filter(tickets, lambda s: s["ticket"] < keep / thin)))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= per_tree)
        .drop("place", "ticket")
    )


def _share(*parts: object) -> float:
    """A number from 0 up to 1 that depends on `parts` alone, like `uniform` of a row."""
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2.0**48


def _grow(sample: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Split a tree's rows by drawn columns and values until alone or at the depth limit.

    The children of node i are 2i and 2i + 1. A node's draws are hashes of the tree's and the node's number.
    """
    tree = int(sample["tree"].iloc[0])
    data = sample[FEATURES].to_numpy(dtype=float)
    limit = ceil(log2(max(len(data), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(data)), 0, 1, -1, 4)]
    while todo:
        rows, depth, name, parent, side = todo.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][side] = here
        part = data[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes.append([tree, here, -1, 0.0, -1, -1, depth + round(expected_depth(len(rows)), 6)])
            continue
        feature = int(open_[int(_share(seed, tree, name, "column") * len(open_))])
        cut = float(low[feature] + _share(seed, tree, name, "value") * (high[feature] - low[feature]))
        goes_left = part[:, feature] <= cut
        nodes.append([tree, here, feature, cut, -1, -1, float(depth)])
        todo.append((rows[goes_left], depth + 1, 2 * name, here, 4))
        todo.append((rows[~goes_left], depth + 1, 2 * name + 1, here, 5))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE.split(", ")])


def _steps(tree: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """A tree as tables: of each node its column, cut, right and left child, a leaf being its own; its depth in millionths."""
    here = np.arange(len(tree["feature"]))
    leaf = tree["feature"] < 0
    child = np.column_stack([np.where(leaf, here, tree[side]) for side in ("right", "left")]).ravel().astype(np.int64)
    return np.where(leaf, 0, tree["feature"]).astype(np.int64), tree["cut"].astype(float), child, np.rint(tree["depth"] * 1e6).astype(np.int64)


def _mean_depth(data: np.ndarray, forest: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Mean depth of each row, from an exact sum of millionths, so equal rows have equal scores in any order of trees."""
    total = np.zeros(len(data), dtype=np.int64)
    flat, row = np.ascontiguousarray(data).ravel(), np.arange(len(data)) * data.shape[1]
    for feature, cut, child, depth in forest:
        at = np.zeros(len(data), dtype=np.int64)
        while True:
            goes_left = flat.take(row + feature.take(at)) <= cut.take(at)
            further = child.take(2 * at + goes_left)
            if np.array_equal(further, at):
                break
            at = further
        total += depth.take(at)
    return total / 1e6 / len(forest)


@dataclass
class AnomalyDetector:
    """A forest as a node table, the scale of its scores and the anomaly threshold."""

    nodes: pd.DataFrame  # at most trees * (2 * rows_per_tree - 1) rows
    rows_per_tree: int
    offset: float = 0.0

    @classmethod
    def train(cls, m: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, seed: int = SEED) -> "AnomalyDetector":
        # Splits are drawn between the least and the greatest value of a column,
        # so standardising the columns first would not change any tree.
        x = _features(m, "order_item_id")
        rows = x.count()
        sample = sample_for_trees(x, rows, trees, ROWS_PER_TREE, seed)

        def grow(rows: pd.DataFrame) -> pd.DataFrame:
            return _grow(rows, seed)

        nodes = sample.groupBy("tree").applyInPandas(grow, NODE).toPandas()
        model = cls(nodes.sort_values(["tree", "node"]).reset_index(drop=True), min(ROWS_PER_TREE, rows))
        # Stored, because finding the quantile reads the scores several times.
        raw = materialize(model._raw_scores(m).select("raw_score"), "anomaly-scores")
        model.offset = exact_quantiles(raw, ["raw_score"], [contamination])["raw_score"][0]
        return model

    def _raw_scores(self, m: DataFrame) -> DataFrame:
        """The fact with raw_score = -2^(-mean depth / expected depth), lower is stranger."""
        forest = [
            {c: part[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")}
            for _, part in self.nodes.groupby("tree")
        ]
        shipped = m.sparkSession.sparkContext.broadcast(forest)  # size fixed by trees and rows_per_tree
        scale = expected_depth(self.rows_per_tree) or 1.0

        @F.pandas_udf("double")
        def raw_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trees = [_steps(tree) for tree in shipped.value]
            for columns in batches:
                data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                yield pd.Series(-np.exp2(-_mean_depth(data, trees) / scale))

        return m.withColumn("raw_score", raw_score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]))

    def score(self, m: DataFrame) -> DataFrame:
        """Every row of the fact with anomaly_score (below 0 is an anomaly) and is_anomaly."""
        gap = F.col("raw_score") - F.lit(self.offset)
        return (
            self._raw_scores(m)
            .withColumn("anomaly_score", gap)
            .withColumn("is_anomaly", (F.col("anomaly_score") < 0).cast("int"))
            .drop("raw_score")
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        table = spark.createDataFrame(self.nodes, NODE)
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.rows_per_tree, self.offset)], "rows_per_tree int, offset double").write.mode(
            "overwrite"
        ).parquet(f"{path}/scale")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AnomalyDetector":
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        scale = spark.read.parquet(f"{path}/scale").first()
        return cls(nodes, scale.rows_per_tree, scale.offset)

    @classmethod
    def load_or_train(cls, spark: SparkSession, path: str, m: DataFrame) -> "AnomalyDetector":
        return load_or_train(cls, spark, path, m)
