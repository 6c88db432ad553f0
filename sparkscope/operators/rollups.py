"""Stored, mergeable summaries per window: totals, quantile sketches, distinct sketches.

A fine rollup is written once; wider windows and fewer keys come from it without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a quantile sketch (rank error about 1.3 % at 200, falling with it) and log2 of a distinct sketch's registers (error 1.6 % at 12).
QUANTILE_SIZE, DISTINCT_BITS = 400, 13


def rollup(df: DataFrame, ts: str, window: str, keys: Sequence[str], value: str, distinct: str | None = None) -> DataFrame:
    """One row per window and key: n, total, low, high, ``quantiles`` (a KLL sketch) and ``uniques`` (an HLL sketch).

    Sketches are partial aggregates like sums, so a hot key sends one row a task. Null values are not counted; a
    window without any has null sketches.
    """
    number = F.col(value).cast("double")
    columns = [
        F.count(value).alias("n"),
        F.sum(number).alias("total"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias("quantiles"),
    ]
    if distinct:
        columns.append(F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(DISTINCT_BITS)).alias("uniques"))
    return df.groupBy(F.window(ts, window)["start"].alias("window_start"), *keys).agg(*columns)


def widen(rolled: DataFrame, window: str, keys: Sequence[str]) -> DataFrame:
    """A rollup by wider windows or fewer keys, from a finer one alone. Windows must nest."""
    columns = [
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    ]
    if "uniques" in rolled.columns:
        columns.append(F.hll_union_agg("uniques").alias("uniques"))
    return rolled.groupBy(F.window("window_start", window)["start"].alias("window_start"), *keys).agg(*columns)


def quantile(p: float) -> Column:
    """The value of rank ``p`` of a rollup's row, null where it has no values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))))


def uniques() -> Column:
    """About how many distinct values a rollup's row has seen."""
    return F.hll_sketch_estimate("uniques")
