"""Ranks, running numbers and quantiles against brute force, with hot values and hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import exact_quantiles
from ledgerline.functions.ranking import rank_descending, running_number


def skewed(spark, rows=3000, seed=7):
    """A third of the rows share one key, one day and one value."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        if i % 3 == 0:
            data.append((f"{i:05d}", "hot", 5, 0.0))
        else:
            value = None if i % 50 == 1 else round(rng.gauss(0, 100), 1)
            data.append((f"{i:05d}", rng.choice(["a", "b", None]), rng.randrange(30), value))
    return spark.createDataFrame(data, "id string, k string, day int, v double").repartition(7)


@pytest.mark.parametrize("by", [(), ("k",)])
def test_rank_equals_window(spark, by):
    df = skewed(spark)
    plain = Window.partitionBy(*by).orderBy(F.col("v").desc_nulls_last())
    want = {r.id: r.want for r in df.withColumn("want", F.rank().over(plain)).collect()}
    got = {r.id: r["rank"] for r in rank_descending(df, "v", "rank", by=by).collect()}
    assert got == want
    assert rank_descending(df.limit(0), "v", "rank", by=by).count() == 0


def test_running_number_equals_window(spark):
    df = skewed(spark)
    plain = Window.partitionBy("k").orderBy("day", "id")
    want = {r.id: r.n if r.k is not None else None for r in df.withColumn("n", F.row_number().over(plain)).collect()}
    got = {r.id: r.n for r in running_number(df, "k", "day", "id", "n").collect()}
    assert got == want
    assert running_number(df.limit(0), "k", "day", "id", "n").count() == 0


@pytest.mark.parametrize("limit", [0, 5, 100, 10**6])
def test_quantiles_equal_numpy(spark, limit):
    df = skewed(spark).withColumn("w", F.exp(F.col("v") / 50)).withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.06, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["v", "w", "day", "e"], probs, short=limit)
    assert got.pop("e") == [None] * len(probs)
    for column, values in got.items():
        data = [r[0] for r in df.select(F.col(column).cast("double")).collect() if r[0] is not None]
        assert values == pytest.approx(list(np.quantile(data, probs)), rel=1e-12)


@pytest.mark.parametrize("values", [[1.0] * 900 + [2.0] * 100, [float(i % 3) for i in range(999)], [5.0], [1.0, 2.0]])
def test_quantiles_of_few_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    assert exact_quantiles(df, ["v"], probs, short=0)["v"] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_materialize_survives_and_keeps_rows(spark):
    from ledgerline.session import materialize, shared_dir

    df = spark.range(10)
    stored = materialize(df, "numbers")
    assert stored.count() == 10
    assert all(shared_dir(spark) in f for f in stored.inputFiles())
