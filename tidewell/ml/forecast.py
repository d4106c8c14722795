"""Seasonal forecasts by series: additive exponential smoothing with prediction intervals, and anomalies by interval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(df: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """(series, day, value) with every day from a series' first to its last; days without rows are 0."""
    ends = df.groupBy(series).agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    days = ends.select(F.col(series).alias("__s"), F.explode(F.sequence("__a", "__b")).alias("__d"))
    out = days.join(df, (F.col("__s") == F.col(series)) & (F.col("__d") == F.col(day)), "left")
    return out.select(F.col("__s").alias(series), F.col("__d").alias(day), F.coalesce(value, F.lit(0)).alias(value))


def smooth(x: np.ndarray, season: int, horizon: int, level_rate: float, trend_rate: float, season_rate: float, z: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One-step forecasts (nan in the first season), forecasts beyond the end, and the errors' deviation.

    The first season gives the level and the seasonal terms, the second one the trend. Under two seasons the mean is the forecast.
    """
    n, ahead = len(x), np.full(len(x), np.nan)
    if n < 2 * season:
        return ahead, np.full(horizon, x.sum() / n), math.nan
    level = x[:season].sum() / season
    trend = (x[season : 2 * season].sum() / season - level) / season
    middle = (season - 1) / 2  # of the first season, which its mean belongs to
    seasonal = [v - (level + (k - middle) * trend) for k, v in enumerate(x[:season])]
    level += middle * trend
    for t in range(season, n):
        s = seasonal[t % season]
        ahead[t] = level + trend + s
        error = x[t] - ahead[t]
        level, trend = level + trend + level_rate * error, trend + level_rate * trend_rate * error
        seasonal[t % season] = s + season_rate * error
    errors = x[season:] - ahead[season:]
    total = 0.0
    for e in errors:
        total += e * e
    beyond = np.array([level + (h + 1) * trend + seasonal[(n + h) % season] for h in range(horizon)])
    return ahead, beyond, math.sqrt(total / len(errors))


def forecast(
    df: DataFrame, series: str, day: str, value: str, season: int = 7, horizon: int = 14, level_rate: float = 0.2, trend_rate: float = 0.1, season_rate: float = 0.1, z: float = 1.96
) -> DataFrame:
    """Of each series (rows of ``daily``): series, kind, day, actual, expected, lo, hi.

    ``forecast`` rows are the ``horizon`` days after the last; their interval widens by how far an error goes on: at step h its
    variance is that of the errors times 1 + sum over j < h of (a (1 + j b) + c [j a multiple of the season])^2. ``anomaly`` rows
    are days whose value lies outside the interval of the forecast made the day before. A series is as long as its days, and one
    task's; series of under two seasons have their mean and no interval. Null values count as 0.
    """
    kind = df.schema[series].dataType.simpleString()
    schema = f"series {kind}, kind string, day date, actual double, expected double, lo double, hi double"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("day")
        x = rows["value"].fillna(0).to_numpy(float)
        ahead, beyond, sigma = smooth(x, season, horizon, level_rate, trend_rate, season_rate, z)
        wide, grown = [], 1.0
        for h in range(1, horizon + 1):
            wide.append(z * sigma * math.sqrt(grown))
            c = level_rate * (1 + h * trend_rate) + (season_rate if h % season == 0 else 0.0)
            grown += c * c
        last = pd.Timestamp(rows["day"].iloc[-1])
        out = [(key[0], "forecast", (last + pd.Timedelta(days=h + 1)).date(), None, float(y), *((float(y - w), float(y + w)) if sigma == sigma else (None, None))) for h, (y, w) in enumerate(zip(beyond, wide, strict=True))]
        for t in np.flatnonzero(np.abs(x - ahead) > z * sigma) if sigma == sigma else ():
            out.append((key[0], "anomaly", rows["day"].iloc[t], float(x[t]), float(ahead[t]), float(ahead[t] - z * sigma), float(ahead[t] + z * sigma)))
        return pd.DataFrame(out, columns=["series", "kind", "day", "actual", "expected", "lo", "hi"])

    long = df.select(F.col(series).alias("series"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("value"))
    return long.groupBy("series").applyInPandas(run, schema).withColumnRenamed("series", series)
