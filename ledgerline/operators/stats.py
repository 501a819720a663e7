"""Descriptive statistics, correlation and outlier tests on the fact."""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import exact_quantiles
from ledgerline.schemas import STATISTICS as NUMERIC



def describe(m: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """One row per numeric column; sample (n-1) moments, exact quartiles, 4 digits.

    The third and fourth moment come from power sums around the mean: plain
    sums, where the built-in aggregates would each keep a state of their own.
    """
    x = m.select(*[F.col(c).cast("double").alias(c) for c in columns])
    centers = x.agg(*[F.avg(c).alias(c) for c in columns]).first()
    quartiles = exact_quantiles(x, columns, [0.25, 0.5, 0.75])

    def sums(c: str) -> Column:
        d = F.col(c) - F.lit(centers[c]).cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.avg(c).alias("mean"), F.var_samp(c).alias("var"),
            F.sum(d).alias("s1"), F.sum(d * d).alias("s2"), F.sum(d * d * d).alias("s3"), F.sum(d * d * d * d).alias("s4"),
            *[F.lit(q).cast("double").alias(f) for f, q in zip(["p25", "p50", "p75"], quartiles[c])],
        )

    n = F.col("count").cast("double")
    shift = F.try_divide(F.col("s1"), n)  # rounding left over from the center
    m2 = F.try_divide(F.col("s2"), n) - shift * shift
    m3 = F.try_divide(F.col("s3"), n) - 3 * shift * F.try_divide(F.col("s2"), n) + 2 * shift**3
    m4 = (
        F.try_divide(F.col("s4"), n) - 4 * shift * F.try_divide(F.col("s3"), n)
        + 6 * shift**2 * F.try_divide(F.col("s2"), n) - 3 * shift**4
    )
    skewness = F.try_divide(m3, m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2)
    excess = F.try_divide(m4, m2 * m2) - 3
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    fields = {
        "mean": F.col("mean"), "std": F.sqrt("var"), "min": F.col("min"),
        "p25": F.col("p25"), "p50": F.col("p50"), "p75": F.col("p75"), "max": F.col("max"), "median": F.col("p50"),
        "var": F.col("var"), "skewness": F.when(n > 2, skewness), "kurtosis": F.when(n > 3, kurtosis),
    }
    rows = x.agg(F.array(*[sums(c) for c in columns]).alias("rows")).select(F.inline("rows"))
    return rows.select("column", "count", *[F.round(value, 4).alias(f) for f, value in fields.items()])


def correlation(m: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Pearson correlation of every pair of the columns that are present, long form, 4 digits.

    A pair uses the rows where both are known. Columns without a NULL share
    their sums around the mean, which is far cheaper than a `corr` per pair.
    """
    names = [c for c in columns if c in m.columns]
    x = m.select(*[F.col(c).cast("double").alias(c) for c in names])
    known = x.agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in names], *[F.avg(c).alias(f"mean_{c}") for c in names]
    ).first()
    full = {c for c in names if known[f"n_{c}"] == known["rows"] and known["rows"] > 0}
    around = {c: F.col(c) - F.lit(known[f"mean_{c}"]) for c in full}
    n = F.lit(float(known["rows"]))

    def product(a: str, b: str) -> Column:
        return F.sum(around[a] * around[b]) - F.sum(around[a]) * F.sum(around[b]) / n

    def value(a: str, b: str) -> Column:
        if a in full and b in full:
            r = F.try_divide(product(a, b), F.sqrt(product(a, a)) * F.sqrt(product(b, b)))
        else:
            r = F.corr(a, b)
        return F.round(F.when(~F.isnan(r), r), 4) + F.lit(0.0)

    pairs = list(combinations(names, 2)) + [(c, c) for c in names]
    computed = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a, b).alias("corr")) for a, b in pairs]
    rows = x.agg(F.array(*computed).alias("rows")).select(F.inline("rows"))
    mirrored = [F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))]
    both = F.when(F.col("a") == F.col("b"), F.array(mirrored[0])).otherwise(F.array(*mirrored))
    return rows.select(F.inline(both), "corr").toDF("col_a", "col_b", "corr")


def outliers_iqr(m: DataFrame, column: str, threshold: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than threshold times their distance, with both bounds."""
    q1, q3 = exact_quantiles(m, [column], [0.25, 0.75])[column]
    if q1 is None:
        return m.withColumns({"lower_bound": F.lit(None), "upper_bound": F.lit(None)}).limit(0)
    low, high = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
    value = F.col(column).cast("double")
    return m.filter((value < low) | (value > high)).withColumns(
        {"lower_bound": F.lit(low), "upper_bound": F.lit(high)}
    )


def outliers_zscore(m: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than threshold population deviations from the mean; NULL counts as 0."""
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    spread = m.agg(F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))).scalar()
    z = F.abs(F.try_divide(value - spread["mean"], spread["std"]))
    return m.filter(z > threshold)
