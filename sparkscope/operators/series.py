"""Time-series analysis per series: ``(series, ts, id, value)`` rows ordered by ``(ts, id)``.

``i`` is the 0-based position in the series. Every step is a partial aggregate or a
block-wise frame, so a series of any length spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.transforms import floor_time

KEY = ["series"]
ORDER = ["ts", "id"]


def points(df: DataFrame, time: str, value: str, series: Column) -> DataFrame:
    """Rows as (series, ts, value); text values are read as numbers, else they are 0.0."""
    number = F.coalesce(F.col(value).cast("string").try_cast("double"), F.lit(0.0))
    return df.select(series.alias("series"), F.col(time).alias("ts"), number.alias("value"))


def index(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Add the position ``i`` of each point and the length ``n`` of its series."""
    return ordered.indexed(df, KEY, ORDER, "i", "n", parts)


def moving_average(df: DataFrame, window: int) -> DataFrame:
    """The mean of every full window of ``window`` points, at its last point.

    A series shorter than the window has none.
    """
    columns = {"moving_avg": lambda w: F.avg("value").over(w.rowsBetween(-(window - 1), 0))}
    return ordered.framed(index(df), KEY, columns, before=window - 1).filter(F.col("i") >= window - 1)


def direction(slope: Column) -> Column:
    return F.when(slope > 0.01, "Increasing").when(slope < -0.01, "Decreasing").otherwise("Stable")


def regression(indexed: DataFrame) -> DataFrame:
    """Least-squares slope, intercept and R2 of value on position, with the series length.

    Positions are centred on the middle of the series before the sums, which keeps
    the sums accurate for long series.
    """
    centred = indexed.withColumn("_x", F.col("i") - (F.col("n") - 1) / 2)
    fit = centred.groupBy(*KEY).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("_mean"),
        F.regr_slope("value", "_x").alias("slope"),
        F.regr_r2("value", "_x").alias("r2"),
    )
    return fit.withColumn("intercept", F.col("_mean") - F.col("slope") * (F.col("n") - 1) / 2).drop("_mean")


def trend(df: DataFrame) -> DataFrame:
    """Slope per step, direction, strength (R2) and confidence of series with two points or more."""
    fit = regression(index(df)).filter("n >= 2")
    return fit.select(
        "series",
        "slope",
        direction(F.col("slope")).alias("direction"),
        F.col("r2").alias("strength"),
        F.least("r2", F.lit(1.0)).alias("confidence"),
    )


def simple_trend(df: DataFrame) -> DataFrame:
    """Direction and strength (the slope's size); Unknown below two points."""
    fit = regression(index(df))
    short = F.col("n") < 2
    return fit.select(
        "series",
        F.when(short, "Unknown").otherwise(direction(F.col("slope"))).alias("direction"),
        F.when(short, 0.0).otherwise(F.abs("slope")).alias("strength"),
    )


def profile(df: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Mean, population deviation, range, trend, and how far the last point is from the mean."""
    placed = index(df)
    fit = regression(placed)
    stats = placed.groupBy(*KEY).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std_dev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", "i").alias("last"),
    )
    score = F.coalesce(F.try_divide(F.abs(F.col("last") - F.col("mean")), F.col("std_dev")), F.lit(0.0))
    short = F.col("n") < 2
    return (
        stats.join(fit, KEY)
        .withColumn("anomaly_score", score)
        .select(
            "series",
            "n",
            "mean",
            "std_dev",
            "min",
            "max",
            "last",
            F.when(short, "Unknown").otherwise(direction(F.col("slope"))).alias("trend"),
            F.when(short, 0.0).otherwise(F.abs("slope")).alias("trend_strength"),
            "anomaly_score",
            (F.col("anomaly_score") > sensitivity).alias("is_anomaly"),
        )
    )


def recent_if_anomalous(df: DataFrame, sensitivity: float = 2.0, last: int = 5) -> DataFrame:
    """The last points of the series whose last point is an anomaly."""
    placed = index(df)
    flagged = profile(df, sensitivity).filter("is_anomaly").select("series")
    return placed.filter(F.col("i") >= F.col("n") - last).join(flagged, "series")


MAX_LAG = 100


def lag_products(df: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """For each lag up to min(n / 2, 100), the mean of ``v[i] * v[i + lag]``.

    A task gets one block of positions with the 100 points that follow it and sums
    the products of all lags at once; the sums then add up per series and lag.
    """
    placed = index(df)
    at = F.col("i") % block
    home = F.floor(F.col("i") / block)
    copies = F.array_compact(F.array(home, F.when((at < MAX_LAG) & (home > 0), home - 1)))
    spread = placed.select("series", "n", "i", "value", F.explode(copies).alias("_block"))

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        v = rows["value"].to_numpy()
        own = int((rows["i"] // block == rows["_block"]).sum())
        n = int(rows["n"].iloc[0])
        lags = range(1, min(n // 2, MAX_LAG) + 1)
        sums, counts = [], []
        for lag in lags:
            pairs = min(own, len(v) - lag)
            sums.append(float(np.dot(v[:pairs], v[lag : lag + pairs])) if pairs > 0 else 0.0)
            counts.append(max(pairs, 0))
        name = np.full(len(lags), rows["series"].iloc[0], dtype=object)
        return pd.DataFrame(
            {
                "series": name,
                "lag": np.array(lags, dtype="int64"),
                "total": np.array(sums, dtype=float),
                "pairs": np.array(counts, dtype="int64"),
            }
        )

    sums = spread.groupBy("series", "_block").applyInPandas(
        products, "series string, lag bigint, total double, pairs bigint"
    )
    return sums.groupBy("series", "lag").agg((F.sum("total") / F.sum("pairs")).alias("autocorrelation"))


def seasonality(df: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """The lag with the largest product mean, for series of ten points or more where it exceeds 0.3."""
    enough = df.groupBy("series").agg(F.count("value").alias("_n")).filter("_n >= 10").select("series")
    best = lag_products(df).groupBy("series").agg(
        F.max_by("lag", F.struct("autocorrelation", "lag")).alias("lag"), F.max("autocorrelation").alias("strength")
    )
    return best.join(enough, "series").filter("strength > 0.3").select(
        "series",
        "lag",
        (F.col("lag") * step_seconds).alias("period_secs"),
        "strength",
        F.least("strength", F.lit(1.0)).alias("confidence"),
    )


def correlation(df: DataFrame, pairs: Sequence[tuple[str, str]], bucket_seconds: int) -> DataFrame:
    """Pearson correlation of the named pairs of series, over the time buckets both have.

    Each series is averaged per bucket first; a mean then goes to the pairs it is part of
    and meets its partner in one group per pair and bucket, without a join.
    """
    side = lambda left, right, own, name: F.when(
        F.col("series") == own, F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(name).alias("side"))
    )
    roles = [side(a, b, own, name) for a, b in pairs for own, name in ((a, "x"), (b, "y"))]
    wanted = sorted({name for pair in pairs for name in pair})
    means = (
        df.filter(F.col("series").isin(wanted))
        .groupBy("series", floor_time(F.col("ts"), bucket_seconds).alias("bucket"))
        .agg(F.avg("value").alias("v"))
    )
    placed = means.select("bucket", "v", F.inline(F.array_compact(F.array(*roles))))
    pick = lambda name: F.max(F.when(F.col("side") == name, F.col("v"))).alias(name)
    met = placed.groupBy("left", "right", "bucket").agg(pick("x"), pick("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return met.groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("buckets"), F.corr("x", "y").alias("correlation")
    )
