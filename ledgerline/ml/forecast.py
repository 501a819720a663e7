"""Monthly revenue forecasts, for the whole fact or one per group.

A group is a few dozen monthly sums, whatever the size of the fact, so each
group is fitted in one small task and the groups run in parallel. Groups with
too short a history get their mean without leaving the JVM.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import present
from ledgerline.schemas import FORECAST_FEATURES as FEATURES

SCHEMA = "month string, step int, forecasted_revenue double, lower_ci double, upper_ci double"
MIN_HISTORY = 6
LAGS = 3


def monthly_revenue(m: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact monthly sums per group."""
    return m.filter(present("month", *keys)).groupBy(*keys, "month").agg(F.sum("net_revenue").alias("net_revenue"))


def monthly_features(m: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Trend, season and the three previous months with sales; the first three drop out."""
    order = Window.partitionBy(*keys).orderBy("month")  # one row per month
    angle = F.substring("month", 6, 2).cast("int") * 2 * F.pi() / 12
    return (
        monthly_revenue(m, keys)
        .withColumn("net_revenue", F.col("net_revenue").cast("double"))
        .withColumn("trend", F.row_number().over(order))
        .withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)})
        .withColumns({f"lag_{i}": F.lag("net_revenue", i).over(order) for i in range(1, LAGS + 1)})
        .dropna()
        .select(*keys, "month", "net_revenue", *FEATURES)
    )


def _row(trend: int, month: int, past: list[float]) -> list[float]:
    angle = 2 * np.pi * month / 12
    return [trend, np.sin(angle), np.cos(angle), past[-1], past[-2], past[-3]]


def forecast_series(months: list[str], revenue: list[float], horizon: int) -> pd.DataFrame:
    """Ordinary least squares on the features, then one month at a time from its own output.

    Needs at least MIN_HISTORY months. The band is NULL where no degree of
    freedom is left to estimate the error.
    """
    steps = range(1, horizon + 1)
    n = len(months)
    month_of = [int(text[5:7]) for text in months]
    x = np.array([_row(i + 1, month_of[i], revenue[:i]) for i in range(LAGS, n)])
    y = np.array(revenue[LAGS:])
    centre_x, centre_y = x.mean(axis=0), y.mean()
    slope = np.linalg.lstsq(x - centre_x, y - centre_y, rcond=None)[0]
    predict = lambda row: float(centre_y + (np.asarray(row) - centre_x) @ slope)

    spare = len(y) - len(FEATURES)
    error = float(np.sqrt(np.sum((y - [predict(r) for r in x]) ** 2) / spare)) if spare > 0 else None
    past, out = list(revenue), []
    last = int(months[-1][:4]) * 12 + month_of[-1] - 1  # months since year 0
    for step in steps:
        year, month = divmod(last + step, 12)
        value = predict(_row(n + step, month + 1, past))
        past.append(value)
        band = None if error is None else 1.96 * error * np.sqrt(1 + 0.1 * (step - 1))
        out.append(
            (
                f"{year}-{month + 1:02d}", step, value,
                None if band is None else max(0.0, value - band),
                None if band is None else value + band,
            )
        )
    return pd.DataFrame(out, columns=["month", "step", "forecasted_revenue", "lower_ci", "upper_ci"])


def short_forecast(monthly: DataFrame, keys: Sequence[str] = (), horizon: int = 6) -> DataFrame:
    """Groups with under six months: the mean stands in, with a band of ten percent."""
    mean = F.try_divide(F.sum("net_revenue").cast("double"), F.count("*").cast("double"))
    short = monthly.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean")).filter(F.col("n") < MIN_HISTORY)
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return short.select(*keys, "mean", step.alias("step")).select(
        *keys,
        F.format_string("Future Month %d", "step").alias("month"), "step",
        F.col("mean").alias("forecasted_revenue"),
        (F.col("mean") * 0.9).alias("lower_ci"), (F.col("mean") * 1.1).alias("upper_ci"),
    )


def fitted_forecast(monthly: DataFrame, keys: Sequence[str] = (), horizon: int = 6) -> DataFrame:
    """Groups with six months or more, each fitted on its own."""
    keys = list(keys)
    history = F.count("*").over(Window.partitionBy(*keys))  # months of one group
    long = monthly.withColumn("n", history).filter(F.col("n") >= MIN_HISTORY).select(
        *keys, "month", F.col("net_revenue").cast("double").alias("net_revenue")
    )
    key_types = "".join(f"`{k}` {monthly.schema[k].dataType.simpleString()}, " for k in keys)

    def one_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("month")
        out = forecast_series(group["month"].tolist(), group["net_revenue"].tolist(), horizon)
        for position, key in enumerate(keys):
            out.insert(position, key, group[key].iloc[0])
        return out

    return long.groupBy(*keys).applyInPandas(one_group, key_types + SCHEMA)


def forecast(m: DataFrame, keys: Sequence[str] = (), horizon: int = 6) -> DataFrame:
    """The next ``horizon`` months of net revenue with a 95 percent band, per group of ``keys``."""
    monthly = monthly_revenue(m, keys)
    return fitted_forecast(monthly, keys, horizon).unionByName(short_forecast(monthly, keys, horizon))
