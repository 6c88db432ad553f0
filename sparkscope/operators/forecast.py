"""Forecasts per series: one row per series and step 1 .. ``horizon``.

Every model needs only sums over the whole series and its last few points, so each
is a partial aggregate per series followed by an explode of the horizon.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.series import KEY, index, profile, regression

ALPHA = 0.3


def _steps(per_series: DataFrame, horizon: int) -> DataFrame:
    return per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def _result(df: DataFrame, model: str, value: Column, low: Column, high: Column, confidence: Column) -> DataFrame:
    return df.select(
        "series",
        F.lit(model).alias("model"),
        "step",
        F.timestamp_micros(F.unix_micros("last_ts") + F.col("step") * 1_000_000).alias("ts"),
        value.alias("predicted"),
        low.alias("lower"),
        high.alias("upper"),
        confidence.alias("confidence"),
    )


def last_mean(window: Column) -> Column:
    """Mean of the last ``window`` points, or the last value when there are fewer."""
    inside = F.col("i") >= F.col("n") - window
    return F.when(F.max("n") >= F.max(window), F.avg(F.when(inside, F.col("value")))).otherwise(
        F.max_by("value", "i")
    )


def smoothed(alpha: float = ALPHA) -> Column:
    """The last value of exponential smoothing that starts at the first point.

    Unrolled, point i has weight alpha * (1 - alpha)^(n - 1 - i), and the first point
    the rest.
    """
    age = F.col("n") - 1 - F.col("i")
    weight = F.when(F.col("i") == 0, F.pow(F.lit(1 - alpha), age)).otherwise(alpha * F.pow(F.lit(1 - alpha), age))
    return F.sum(weight * F.col("value"))


def _base(placed: DataFrame) -> DataFrame:
    """Per series: length, last time and value, moving-average and smoothed levels."""
    window = F.least(F.greatest(F.floor(F.col("n") / 4), F.lit(3)), F.lit(20))
    return placed.groupBy(*KEY).agg(
        F.max("n").alias("n"),
        F.max_by("ts", "i").alias("last_ts"),
        F.max_by("value", "i").alias("last"),
        last_mean(window).alias("sma"),
        last_mean(F.lit(10)).alias("ma10"),
        smoothed().alias("ses"),
        F.stddev_samp("value").alias("sd"),
    )


def _models(df: DataFrame) -> DataFrame:
    placed = index(df)
    fit = regression(placed).drop("n")
    return _base(placed).join(fit, KEY)


def moving_average(df: DataFrame, horizon: int) -> DataFrame:
    """Flat at the mean of the last n / 4 points (3 to 20)."""
    p = F.col("sma")
    return _result(_steps(_base(index(df)), horizon), "SimpleMovingAverage", p, p * 0.9, p * 1.1, F.lit(0.7))


def linear(df: DataFrame, horizon: int) -> DataFrame:
    """The regression line at position n + step."""
    p = F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")
    width = F.greatest(1 - F.col("r2"), F.lit(0.1)) * F.abs(p) * 0.2
    out = _steps(_models(df).filter("n >= 2"), horizon)
    return _result(out, "LinearRegression", p, p - width, p + width, F.greatest("r2", F.lit(0.5)))


def smoothing(df: DataFrame, horizon: int) -> DataFrame:
    """Flat at the smoothed level."""
    p = F.col("ses")
    return _result(_steps(_base(index(df)), horizon), "ExponentialSmoothing", p, p * 0.85, p * 1.15, F.lit(0.75))


def decomposition(df: DataFrame, horizon: int, model: str = "ARIMA") -> DataFrame:
    """The last trend level times the step, plus the seasonal part of that step.

    The period p is max(n / 4, 2). The trend at i is the mean of the p points from i on
    (the value itself where fewer are left), and the seasonal part at s is the sum of
    value minus trend at s, s + p, s + 2p, ... over the number of whole periods.
    Multiplying the trend level by the step is how the model is defined.

    The trend windows that start at s, s + p, ... lie side by side, so their means add
    up to one sum over the points they cover; each step needs two conditional sums.
    """
    period = F.greatest(F.floor(F.col("n") / 4), F.lit(2)).cast("bigint")
    placed = index(df).withColumn("p", period)
    value, i, n, p = F.col("value"), F.col("i"), F.col("n"), F.col("p")
    sums = []
    for step in range(1, horizon + 1):
        s = F.lit(step) % p
        end = s + F.floor((n - s) / p) * p
        covered = (i >= s) & (i < end)
        sums.append(F.sum(F.when(covered & (i % p == s), value).otherwise(0.0)).alias(f"_own{step}"))
        sums.append(F.sum(F.when(covered, value).otherwise(0.0)).alias(f"_all{step}"))
    per_series = placed.groupBy(*KEY).agg(
        F.max("n").alias("n"),
        F.max("p").alias("p"),
        F.max_by("ts", "i").alias("last_ts"),
        F.max_by("value", "i").alias("_last"),
        F.avg(F.when(i >= n - p, value)).alias("_trend"),
        *sums,
    )
    short = F.col("n") < 4
    parts = [
        F.struct(
            F.lit(step).alias("step"),
            F.when(short, 0.0)
            .otherwise((F.col(f"_own{step}") - F.col(f"_all{step}") / F.col("p")) / F.floor(F.col("n") / F.col("p")))
            .alias("seasonal"),
        )
        for step in range(1, horizon + 1)
    ]
    level = F.when(short, F.col("_last")).otherwise(F.col("_trend"))
    out = per_series.select("series", "last_ts", level.alias("trend"), F.inline(F.array(*parts)))
    predicted = F.col("trend") * F.col("step") + F.col("seasonal")
    width, confidence = {"ARIMA": (0.2, 0.8), "Prophet": (0.15, 0.85)}[model]
    return _result(out, model, predicted, predicted * (1 - width), predicted * (1 + width), F.lit(confidence))


def ensemble(df: DataFrame, horizon: int) -> DataFrame:
    """0.4 linear + 0.4 smoothing + 0.2 moving average; less confident the more they differ."""
    line = F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")
    p = line * 0.4 + F.col("ses") * 0.4 + F.col("sma") * 0.2
    mean = (line + F.col("ses") + F.col("sma")) / 3
    variance = (F.pow(line - mean, 2) + F.pow(F.col("ses") - mean, 2) + F.pow(F.col("sma") - mean, 2)) / 2
    out = _steps(_models(df).filter("n >= 2"), horizon)
    return _result(out, "Ensemble", p, p * 0.8, p * 1.2, F.greatest(1 / (1 + variance), F.lit(0.6)))


def naive(df: DataFrame, horizon: int) -> DataFrame:
    """The last value moved by the trend's strength per step; flat without a trend."""
    sign = F.when(F.col("trend") == "Increasing", 1).when(F.col("trend") == "Decreasing", -1).otherwise(0)
    p = F.col("last") + sign * F.col("trend_strength") * F.col("step")
    return _steps(profile(df).filter("n >= 2"), horizon).select("series", "step", p.alias("predicted"))


def differenced(df: DataFrame, horizon: int, d: int = 1, alpha: float = ALPHA) -> DataFrame:
    """The smoothed level of the series after ``d`` rounds of differencing.

    The d-th difference at i is a fixed sum of the d + 1 last values with binomial weights.
    """
    def difference(w) -> Column:
        total = F.lit(0.0)
        for k in range(d + 1):
            total = total + (-1) ** k * comb(d, k) * F.lag("value", k).over(w)
        return total

    placed = ordered.framed(index(df), KEY, {"_diff": difference}, before=d) if d else index(df).withColumn("_diff", F.col("value"))
    moved = placed.filter(F.col("i") >= d).select(
        "series", (F.col("i") - d).alias("i"), (F.col("n") - d).alias("n"), F.col("_diff").alias("value")
    )
    level = moved.groupBy(*KEY).agg(smoothed(alpha).alias("predicted"))
    return _steps(level, horizon).select("series", "step", "predicted")


def model_mean(df: DataFrame, horizon: int) -> DataFrame:
    """Mean of a moving average of 10, the line from position n on, and smoothing; 95 % band."""
    line = F.col("slope") * (F.col("n") + F.col("step") - 1) + F.col("intercept")
    p = (F.col("ma10") + line + F.col("ses")) / 3
    margin = 1.96 * F.coalesce(F.col("sd"), F.lit(0.0))
    return _steps(_models(df).filter("n >= 10"), horizon).select(
        "series", "step", p.alias("predicted"), (p - margin).alias("lower"), (p + margin).alias("upper")
    )
