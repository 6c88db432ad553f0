"""Anomaly detectors per series: each returns the flagged points with their deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.series import KEY, index

COLUMNS = ["series", "ts", "id", "i", "value", "deviation"]


def _flag(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("deviation") > threshold).select(*COLUMNS)


def _with(df: DataFrame, per_series: DataFrame) -> DataFrame:
    """Join one row per series to its points."""
    return df.join(per_series, KEY)


def zscore(placed: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Distance from the mean in sample deviations; nothing below two points or without spread."""
    norm = placed.groupBy(*KEY).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_sd"))
    score = F.try_divide(F.abs(F.col("value") - F.col("_m")), F.col("_sd"))
    return _flag(_with(placed, norm.filter("_sd > 0")).withColumn("deviation", score), threshold)


def moving_average(placed: DataFrame, window: int = 10, threshold: float = 3.0) -> DataFrame:
    """Relative distance from the mean of the ``window`` points before."""
    columns = {"_ma": lambda w: F.avg("value").over(w.rowsBetween(-window, -1))}
    near = ordered.framed(placed, KEY, columns, before=window).filter(F.col("i") >= window)
    score = F.abs(F.col("value") - F.col("_ma")) / F.greatest(F.abs("_ma"), F.lit(1e-10))
    return _flag(near.withColumn("deviation", score), threshold)


def iqr(placed: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Points beyond the quartiles by ``multiplier`` ranges; the deviation counts from there in ranges.

    Nothing below four points.
    """
    ranks = {"_q1": lambda n: F.floor(n * 0.25), "_q3": lambda n: F.floor(n * 0.75)}
    quartiles = ordered.values_at(placed, KEY, "value", ranks, total="_n").filter("_n >= 4")
    spread = F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - multiplier * spread, F.col("_q3") + multiplier * spread
    v = F.col("value")
    beyond = F.when(v < low, low - v).when(v > high, v - high)
    scored = _with(placed, quartiles).withColumn("_beyond", beyond).filter("_beyond IS NOT NULL")
    return scored.withColumn("deviation", F.try_divide("_beyond", spread)).select(*COLUMNS)


def trend(placed: DataFrame, window: int = 10, threshold: float = 0.5) -> DataFrame:
    """Relative distance from the last value plus the slope of the ``window`` points before.

    Nothing in series shorter than two windows.
    """
    columns = {
        "_slope": lambda w: F.regr_slope("value", "i").over(w.rowsBetween(-window, -1)),
        "_last": lambda w: F.lag("value").over(w),
    }
    near = ordered.framed(placed.filter(F.col("n") >= 2 * window), KEY, columns, before=window)
    expected = F.col("_last") + F.coalesce(F.col("_slope"), F.lit(0.0))
    score = F.abs(F.col("value") - expected) / F.greatest(F.abs(expected), F.lit(1e-10))
    return _flag(near.filter(F.col("i") >= window).withColumn("deviation", score), threshold)


def seasonal(placed: DataFrame, period: int, threshold: float = 0.5) -> DataFrame:
    """Relative distance from the value one period earlier; nothing below two periods.

    The earlier point is found by its position, so the period may be of any length.
    """
    long = placed.filter(F.col("n") >= 2 * period)
    earlier = long.select("series", (F.col("i") + period).alias("i"), F.col("value").alias("_then"))
    score = F.abs(F.col("value") - F.col("_then")) / F.greatest(F.abs("_then"), F.lit(1e-10))
    return _flag(long.join(earlier, ["series", "i"]).withColumn("deviation", score), threshold)


def ensemble(df: DataFrame, z: float = 3.0, window: int = 10, ma: float = 3.0, iqr_range: float = 1.5, threshold: float = 3.0) -> DataFrame:
    """All findings of the z-score, moving-average and IQR detectors, with type, severity and confidence.

    A point found by several detectors appears once for each.
    """
    placed = index(df)
    found = None
    for name, kind, one in (
        ("z_score_detector", "Point", zscore(placed, z)),
        ("moving_average_detector", "Contextual", moving_average(placed, window, ma)),
        ("iqr_detector", "Point", iqr(placed, iqr_range)),
    ):
        named = one.withColumns({"detector": F.lit(name), "anomaly_type": F.lit(kind)})
        found = named if found is None else found.unionByName(named)
    return found.withColumns(
        {
            "severity": F.least(F.col("deviation") / threshold, F.lit(10.0)) / 10,
            "confidence": 1 - F.col("deviation") / (F.col("deviation") + 1),
        }
    )


def latency_spikes(log: DataFrame, duration: str = "duration_ms", key: str | None = None) -> DataFrame:
    """Log rows beyond three population deviations, with severity and the expected range.

    Nothing below five rows or without spread.
    """
    keys = [key] if key else []
    keyed = log if keys else log.withColumn("_all", F.lit(0))
    keys = keys or ["_all"]
    norm = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.avg(duration).alias("_m"), F.stddev_pop(duration).alias("_sd")
    )
    score = (F.col(duration) - F.col("_m")) / F.col("_sd")
    scored = keyed.join(norm.filter("_rows >= 5 AND _sd > 0"), keys).withColumn("deviation", score)
    return (
        scored.filter(F.abs("deviation") > 3)
        .withColumns(
            {
                "severity": F.when(F.col("deviation") > 5, "Critical").otherwise("High"),
                "expected_low": F.col("_m") - 2 * F.col("_sd"),
                "expected_high": F.col("_m") + 2 * F.col("_sd"),
            }
        )
        .drop("_rows", "_m", "_sd", "_all")
    )
