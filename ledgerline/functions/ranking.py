"""Ranks and running numbers that never put a whole table, or a hot key, in one task."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame) -> int:
    """Ranges that ordered values are cut into: as many as a shuffle has partitions, so a range grows no faster."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rank_descending(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """SQL ``RANK() OVER ([PARTITION BY by] ORDER BY value DESC)`` at any size.

    Rows are ranked over their distinct values: they are counted (so ties shrink
    to one row), cut into value ranges, and each range gets the number of rows
    above it. Lazy: the edges of the ranges are a scalar subquery.
    """
    by = list(by)
    keys = [*by, value]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    n = _ranges(df)
    kind = df.schema[value].dataType.simpleString()
    edges = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000)).scalar()  # n - 1 numbers
    edges = F.coalesce(edges.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    # NULL ranks last, in a range of its own.
    bucket = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    counts = counts.withColumn("_edges", edges).withColumn("_bucket", bucket).drop("_edges")

    above = Window.partitionBy(*by).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy(*by, "_bucket")
        .agg(F.sum("_rows").alias("_rows"))
        .select(*by, "_bucket", F.coalesce(F.sum("_rows").over(above), F.lit(0)).alias("_above"))
    )
    within = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(F.col(value).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    ranks = _null_safe_join(local, offsets, [*by, "_bucket"]).select(
        *keys, (F.col("_above") + F.col("_before") + 1).cast("int").alias(out)
    )
    return _null_safe_join(df, ranks, keys)


def running_number(df: DataFrame, key: str, bucket: str, tie: str, out: str) -> DataFrame:
    """1-based running number of the rows of each key, ordered by (bucket, tie).

    Equal to ``row_number() over (partition by key order by bucket, tie)``, but
    no task holds a whole key: rows are numbered within (key, bucket, range of
    tie), and the rows of earlier ranges come from counts. ``bucket`` is a coarse
    column such as a date, so the counts of a key stay few. Lazy: the edges of
    the ranges, a sample of ties that depends on their values alone, are a
    scalar subquery.
    """
    sample = df.select(tie).where(F.col(tie).isNotNull()).distinct().orderBy(F.xxhash64(tie), tie).limit(_ranges(df))
    edges = sample.agg(F.collect_list(tie)).scalar()
    stored = df.withColumn("_edges", edges)
    stored = stored.withColumn("_range", F.size(F.filter("_edges", lambda e: e <= F.col(tie)))).drop("_edges")
    parts = [bucket, "_range"]

    inside = Window.partitionBy(key, *parts).orderBy(F.col(tie).asc_nulls_last())
    numbered = stored.withColumn("_in_bucket", F.row_number().over(inside))
    earlier = (
        Window.partitionBy(key)
        .orderBy(*[F.col(p).asc_nulls_last() for p in parts])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        stored.groupBy(key, *parts)
        .agg(F.count("*").alias("_rows"))
        .select(key, *parts, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_earlier"))
    )
    return (
        _null_safe_join(numbered, offsets, [key, *parts])
        .withColumn(out, F.when(F.col(key).isNotNull(), F.col("_earlier") + F.col("_in_bucket")))
        .drop("_in_bucket", "_earlier", "_range")
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])
