"""Customer segments: features per customer, k-means, persona names."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import mean_of, present, total
from ledgerline.ml.saved import load_or_train
from ledgerline.schemas import SEGMENT_FEATURES as FEATURES
from ledgerline.session import materialize

KEYS = ["customer_id", "customer_name", "customer_segment"]
RESTARTS, ROUNDS = 10, 20
PART = f"start int, cluster int, n double, {', '.join(f'{f} double' for f in FEATURES)}"

# Persona names.
RETURN_RISK, VIP = "High Return Risk", "VIP High-Value"
DISCOUNT, STANDARD = "Discount Seekers", "Standard Customers"


def rfm(m: DataFrame) -> DataFrame:
    """Recency, frequency, monetary value, mean discount and return rate per customer."""
    last_day = m.agg(F.max("order_date")).scalar()
    per_customer = m.filter(present(*KEYS)).groupBy(*KEYS).agg(
        F.max("order_date").alias("last_order"),
        F.countDistinct("order_id").alias("frequency"),
        total("net_revenue").alias("monetary"),
        mean_of("discount_percentage").alias("discount_percentage"),
        mean_of("is_returned").alias("is_returned"),
    )
    return per_customer.withColumn("recency", F.date_diff(last_day, "last_order")).select(*KEYS, *FEATURES)


def name_personas(centers: list[dict[str, float]]) -> dict[int, str]:
    """Name the four clusters from their centers, each name taken once.

    Most returns first, then highest value, then deepest discount; the one left
    over is standard. The lower cluster number wins a tie.
    """
    if len(centers) != 4:
        raise ValueError("personas need exactly four clusters")
    left, names = list(range(4)), {}
    for persona, feature in ((RETURN_RISK, "is_returned"), (VIP, "monetary"), (DISCOUNT, "discount_percentage")):
        pick = max(left, key=lambda i: centers[i][feature])
        names[pick] = persona
        left.remove(pick)
    names[left[0]] = STANDARD
    return names


def _constant(numbers: list | float) -> Column:
    """Nested arrays of doubles, as one text: a call for each number would take longer than a round."""
    text = lambda x: f"array({', '.join(map(text, x))})" if isinstance(x, list) else f"{x!r}D"
    return F.expr(text(numbers))


def _gaps(point: list[Column], centers: Column) -> Column:
    """Squared distances to all centers, an array of arrays: a constant of the plan, so that code compiled for it serves all rounds."""
    return F.transform(centers, lambda c: reduce(add, [(x - c[i]) * (x - c[i]) for i, x in enumerate(point)]))


def _nearest(gaps: Column) -> Column:
    """The number of the nearest center, the lower one of equally near ones."""
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def _parts(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of this task's customers, by start and nearest center: how many there are and the sums of their features."""
    starts, k, width = centers.shape
    sums = np.zeros((1 + width, starts * k))
    for batch in batches:
        point = [column.to_numpy() for column in batch.columns]
        for start in range(starts):
            gaps = [reduce(add, [(x - c) * (x - c) for x, c in zip(point, center)]) for center in centers[start]]
            index = start * k + np.argmin(gaps, axis=0)  # the first of equally near ones
            for i, x in enumerate([None, *point]):
                sums[i] += np.bincount(index, x, starts * k)
    held = np.flatnonzero(sums[0])
    columns = [(held // k).astype(np.int32), (held % k).astype(np.int32), *sums[:, held]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["start", "cluster", "n", *FEATURES])


@dataclass
class Segmenter:
    """Centers of clusters in standardised features, and the persona of each cluster."""

    mean: list[float]
    std: list[float]
    centers: list[list[float]]
    names: dict[int, str]

    @classmethod
    def of(cls, mean: list[float], std: list[float], centers: list[list[float]]) -> "Segmenter":
        plain = [dict(zip(FEATURES, [c * s + m for c, s, m in zip(center, std, mean)])) for center in centers]
        return cls(mean, std, centers, name_personas(plain))

    @classmethod
    def train(
        cls, m: DataFrame, k: int = 4, seed: int = 42, restarts: int = RESTARTS, rounds: int = ROUNDS
    ) -> "Segmenter":
        """Lloyd's rounds from several starts at once; the start with the lowest cost wins.

        A start is the k customers with the lowest hashes of their keys. A round is one pass over a stored row for
        each customer; a task returns k sums for each start. A cluster that loses all its customers keeps its center.
        """
        customers = materialize(rfm(m).fillna(0.0, FEATURES), "customer-features")
        doubles = [F.col(f).cast("double") for f in FEATURES]
        spread = customers.agg(*[f(c) for c in doubles for f in (F.avg, F.stddev_samp)]).first()
        mean, std = [x or 0.0 for x in spread[::2]], [x or 0.0 for x in spread[1::2]]
        scaled = customers.select(*KEYS, *[
            ((c - a) / b if b else F.lit(0.0)).alias(f) for f, c, a, b in zip(FEATURES, doubles, mean, std)
        ])
        ticket = lambda r: F.md5(F.concat_ws("|", F.lit(f"{seed}|{r}"), *KEYS))
        first = [
            scaled.select(F.lit(r).alias("start"), ticket(r).alias("ticket"), *KEYS, *FEATURES)
            .orderBy("ticket", *KEYS).limit(k)
            for r in range(restarts)
        ]
        centers: list[list[list[float]]] = [[] for _ in range(restarts)]
        for r in sorted(reduce(DataFrame.unionAll, first).collect(), key=lambda r: (r["start"], r["ticket"])):  # k rows a start
            centers[r["start"]].append([r[f] for f in FEATURES])
        here = [F.col(f) for f in FEATURES]
        for _ in range(rounds):
            now = np.array(centers).reshape(restarts, -1, len(FEATURES))

            def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                return _parts(batches, now)

            parted = scaled.select(*FEATURES).mapInArrow(parts, PART)  # a row for each center and task
            means = parted.groupBy("start", "cluster").agg(*[(F.sum(f) / F.sum("n")).alias(f) for f in FEATURES])
            moved = 0.0  # until rounding alone moves a center
            for row in means.collect():  # a row for each center
                new = [row[f] for f in FEATURES]
                old = centers[row["start"]][row["cluster"]]
                moved = max(moved, *(abs(a - b) for a, b in zip(new, old)))
                centers[row["start"]][row["cluster"]] = new
            if moved < 1e-9:
                break
        costs = scaled.agg(*[F.sum(F.array_min(_gaps(here, _constant(c)))) for c in centers]).first()
        # Starts that end in the same clusters differ in the last bits of their costs alone.
        best = min(range(restarts), key=lambda r: (round(costs[r] or 0.0, 6), r))
        return cls.of(mean, std, centers[best])

    def score(self, m: DataFrame) -> DataFrame:
        """Every customer of the fact with cluster and segment_name, without refitting."""
        scaled = [
            (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - mean) / std if std else F.lit(0.0)
            for f, mean, std in zip(FEATURES, self.mean, self.std)
        ]
        cluster = _nearest(_gaps(scaled, _constant(self.centers)))
        persona = F.create_map(*[F.lit(x) for pair in self.names.items() for x in pair])
        scored = rfm(m).fillna(0.0, FEATURES).withColumn("cluster", cluster)
        return scored.select(*KEYS, *FEATURES, "cluster", persona[F.col("cluster")].alias("segment_name"))

    def save(self, path: str) -> None:
        rows = [(-2, self.mean, None), (-1, self.std, None)] + [(i, c, self.names[i]) for i, c in enumerate(self.centers)]
        SparkSession.active().createDataFrame(rows, "cluster int, center array<double>, name string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/centers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Segmenter":
        rows = {r.cluster: r for r in spark.read.parquet(f"{path}/centers").collect()}  # a row for each cluster
        ids = sorted(i for i in rows if i >= 0)
        return cls(list(rows[-2].center), list(rows[-1].center), [list(rows[i].center) for i in ids], {i: rows[i].name for i in ids})

    @classmethod
    def load_or_train(cls, spark: SparkSession, path: str, m: DataFrame) -> "Segmenter":
        return load_or_train(cls, spark, path, m)
