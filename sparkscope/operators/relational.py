"""SQL windows on keys of any size, and joins that watch their fan-out.

Joins, sorts, set operations and subqueries are Spark's own; this module holds only
what needs more than one DataFrame call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rn") -> DataFrame:
    """ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)."""
    return ordered.indexed(df, keys, order).withColumn(out, F.col("i") + 1).drop("i")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, steps: int = 1) -> DataFrame:
    """Add ``previous`` and ``next``: LAG and LEAD of ``value`` by ``steps`` rows."""
    placed = ordered.indexed(df, keys, order)
    columns = {
        "previous": lambda w: F.lag(value, steps).over(w),
        "next": lambda w: F.lead(value, steps).over(w),
    }
    return ordered.framed(placed, keys, columns, before=steps, after=steps).drop("i")


def tiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, out: str = "tile") -> DataFrame:
    """NTILE(n): the first ``count % n`` tiles hold one row more than the others."""
    placed = ordered.indexed(df, keys, order, "_i", "_n")
    size, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    wide = extra * (size + 1)
    tile = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (size + 1))).otherwise(
        extra + F.floor((F.col("_i") - wide) / F.greatest(size, F.lit(1)))
    )
    return placed.withColumn(out, (tile + 1).cast("int")).drop("_i", "_n")


def ends(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add the first and last ``value`` of the whole key, by ``order``, to every row."""
    first_last = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min_by(value, F.struct(*order)).alias("first_value"), F.max_by(value, F.struct(*order)).alias("last_value")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(first_last, on).drop(*[f"_k_{k}" for k in keys])


def range_sum(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: int, out: str = "range_sum"
) -> DataFrame:
    """Sum of ``value`` over the rows of the last ``seconds`` up to and including each row's time.

    The sum is the difference of two running totals, one at the row's time and one just
    before the range starts; both kinds of mark are placed in one ordered pass, so it
    does not matter how many rows fall into one range. Decimals keep the totals exact.
    """
    width = seconds * 1_000_000
    sums = df.groupBy(*keys, F.unix_micros(ts).alias("_us")).agg(
        F.sum(F.col(value).cast("decimal(20,9)")).alias("_sum")
    )
    mark = lambda at, kind, weight: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), weight.alias("_add"))
    start, here = mark(F.col("_us") - width, 0, F.col("_sum") * 0), mark(F.col("_us"), 1, F.col("_sum") * 1)
    marks = sums.select(*keys, "_us", F.inline(F.array(start, here)))
    totals = ordered.cumulative(marks, keys, ["_at", "_kind", "_us"], "_add", "_before", "_all")
    at_row = F.max(F.when(F.col("_kind") == 1, F.col("_before") + F.col("_add")))
    at_start = F.max(F.when(F.col("_kind") == 0, F.col("_before")))
    found = totals.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_us").alias("_t")).agg(
        (at_row - at_start).cast("double").alias(out)
    )
    on = F.unix_micros(ts) == F.col("_t")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(found, on).drop("_t", *[f"_k_{k}" for k in keys])


def deviation(live: DataFrame, history: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Live rows with the historical mean of their key and the distance to it.

    ``live`` may be a stream; the history is one row per key.
    """
    means = history.groupBy(*keys).agg(F.avg(value).alias("historical_avg"))
    return live.join(means, list(keys), "inner").withColumn("deviation", F.col(value) - F.col("historical_avg"))


def top(df: DataFrame, by: Column, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the highest ``by``; ``ties`` order equal ones."""
    return df.orderBy(by.desc_nulls_last(), *ties).limit(k)
