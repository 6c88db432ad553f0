"""Event-time windows: the same functions serve batch frames and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import aggregates as ag, ordered


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """On a stream, results may be final once event time is ``delay`` past them; no change to a batch."""
    return df.withWatermark(ts, delay) if df.isStreaming else df


def check_bounded(df: DataFrame, watermark: str | None) -> None:
    """A windowed stream without a watermark would keep its state for ever."""
    if df.isStreaming and not watermark:
        raise ValueError("a windowed stream needs a watermark")


def _windowed(df: DataFrame, window: Column, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    grouped = df.groupBy(window.alias("w"), *keys).agg(*aggs)
    rest = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, ts: str, size: str, keys: Sequence[str], aggs: Sequence[Column], delay: str | None = None) -> DataFrame:
    """Windows of ``size`` side by side, counted from the epoch."""
    check_bounded(df, delay)
    return _windowed(watermarked(df, ts, delay or "0 seconds"), F.window(ts, size), keys, aggs)


def sliding(
    df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggs: Sequence[Column], delay: str | None = None
) -> DataFrame:
    """Windows of ``size`` that start every ``slide``; a row counts in each window that holds it."""
    check_bounded(df, delay)
    return _windowed(watermarked(df, ts, delay or "0 seconds"), F.window(ts, size, slide), keys, aggs)


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Sequence[Column], delay: str | None = None) -> DataFrame:
    """Runs of rows of a key with pauses shorter than ``gap``."""
    check_bounded(df, delay)
    return _windowed(watermarked(df, ts, delay or "0 seconds"), F.session_window(ts, gap), keys, aggs)


def by_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, aggs: Sequence[Column]) -> DataFrame:
    """Windows of ``size`` consecutive rows per key (batch); the last one may be open."""
    placed = ordered.indexed(df, keys, order)
    window = F.floor(F.col("i") / size).alias("window_no")
    return placed.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("rows"), *aggs).withColumn(
        "closed", F.col("rows") == size
    )


def exact_stats(df: DataFrame, ts: str, size: str, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """count, sum, avg, min, max, deviation, median and percentiles per window and key, over every value."""
    windowed = df.withColumn("window_start", F.window(ts, size)["start"])
    by = ["window_start", *keys]
    stats = windowed.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.round(F.sum(value), 6).alias("total"),
        F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std_dev"),
    )
    ranks = {**ag.MIDDLE, **{f"p{p:g}": ag.round_rank(p) for p in ps}}
    ranked = ordered.values_at(windowed, by, value, ranks)
    joined = stats.join(ranked, by)
    return joined.withColumn("median", F.round((F.col("_low") + F.col("_high")) / 2, 6)).drop("_low", "_high")
