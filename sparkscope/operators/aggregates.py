"""Group aggregations: rule sets, exact percentiles, rates, histograms and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered
from sparkscope.operators.flatten import metric_number

R = 6


def group_key(c: Column) -> Column:
    """The group of a row; rows without one form the group ``default``."""
    return F.coalesce(c, F.lit("default"))


def core(df: DataFrame, key: Column | None, value: str) -> DataFrame:
    """count, sum, avg, min and max per group (or of everything)."""
    grouped = df.groupBy((F.lit("default") if key is None else group_key(key)).alias("group_key"))
    return grouped.agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(value), R).alias("sum"),
        F.round(F.avg(value), R).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def number_of(name: str) -> Column:
    """A record's number called ``name``: attribute, tag, or the value of a metric of that name."""
    return F.coalesce(
        F.col("attributes")[name].try_cast("double"),
        F.col("tags")[name].try_cast("double"),
        F.when(F.col("metric.name") == name, metric_number()),
    )


FUNCTIONS = {
    "count": lambda c, t: F.count(F.lit(1)),
    "sum": lambda c, t: F.round(F.sum(c), R),
    "avg": lambda c, t: F.round(F.avg(c), R),
    "min": lambda c, t: F.min(c),
    "max": lambda c, t: F.max(c),
    "std": lambda c, t: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), R),
    "var": lambda c, t: F.round(F.coalesce(F.var_samp(c), F.lit(0.0)), R),
    "first": lambda c, t: F.min_by(c, F.struct(*t)),
    "last": lambda c, t: F.max_by(c, F.struct(*t)),
    "distinct": lambda c, t: F.countDistinct(c).cast("double"),
}


@dataclass(frozen=True)
class AggregateRule:
    """A named set of functions over a value, per group, over the rows a condition keeps."""

    name: str
    group_by: Sequence[str] = ()
    functions: Sequence[str] = ("count",)
    value: str = "value"
    where: Column | None = None
    enabled: bool = True


def by_rules(df: DataFrame, rules: Sequence[AggregateRule], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """One row per rule, group and function: _rule_name, _group_key, _record_count, function, result.

    Without an enabled rule the rows pass through unchanged.
    """
    active = [r for r in rules if r.enabled]
    if not active:
        return df
    # One scan: each row once for every rule it belongs to, grouped by rule and key.
    entries = []
    for rule in active:
        parts = [group_key(F.col(c).cast("string")) for c in rule.group_by]
        key = F.concat_ws("|", *parts) if parts else F.lit("default")
        entry = F.struct(F.lit(rule.name).alias("_rule_name"), key.alias("_group_key"), F.col(rule.value).alias("_value"))
        entries.append(entry if rule.where is None else F.when(rule.where, entry))
    rows = df.select(*order, F.inline(F.array_compact(F.array(*entries))))
    names = list(dict.fromkeys(f for r in active for f in r.functions))
    grouped = rows.groupBy("_rule_name", "_group_key").agg(
        F.count(F.lit(1)).alias("_record_count"), *[FUNCTIONS[f](F.col("_value"), order).cast("double").alias(f) for f in names]
    )
    results = F.inline(F.array(*[F.struct(F.lit(f).alias("function"), F.col(f).alias("result")) for f in names]))
    wanted = F.lit(False)
    for rule in active:
        wanted = wanted | ((F.col("_rule_name") == rule.name) & F.col("function").isin(list(rule.functions)))
    return grouped.select("_rule_name", "_group_key", "_record_count", results).filter(wanted)


# -- order statistics ------------------------------------------------------------------


def floor_rank(p: float):
    """Nearest rank ``floor(p / 100 * n)``, at most the last value."""
    return lambda n: F.least(F.floor(F.lit(p) / 100 * n), n - 1)


def round_rank(p: float):
    """Rank ``round(p / 100 * (n - 1))``, halves up."""
    return lambda n: F.floor(F.lit(p) / 100 * (n - 1) + 0.5)


MIDDLE = {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float], rank=floor_rank) -> DataFrame:
    """Exact percentiles as columns ``p<p>``; ``rank`` is :func:`floor_rank` or :func:`round_rank`."""
    return ordered.values_at(df, keys, value, {f"p{p:g}": rank(p) for p in ps})


def median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median: the mean of the middle two."""
    found = ordered.values_at(df, keys, value, MIDDLE)
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(out))


def histogram(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, buckets: int) -> DataFrame:
    """Rows per equal-width bucket; 0 is below ``low`` and ``buckets + 1`` from ``high`` up."""
    bucket = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(buckets))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rate(ts: str, per_seconds: float = 1.0) -> Column:
    """Rows per ``per_seconds`` between the first and last row; 0 without a span."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return F.coalesce(F.try_divide(F.count(F.lit(1)), span) * per_seconds, F.lit(0.0))


def error_share(status: Column) -> Column:
    """Share of rows with a status from 400 up; text that is no status counts as 200."""
    code = F.coalesce(status.try_cast("int"), F.lit(200))
    return F.coalesce(F.avg(F.when(status.isNotNull(), F.when(code >= 400, 1.0).otherwise(0.0))), F.lit(0.0))


def summary(df: DataFrame, keys: Sequence[str], value: str, std: str = "sample", quartiles: str = "index") -> DataFrame:
    """count, mean, std, min, max, median, q1, q3, skewness and excess kurtosis per key.

    ``std`` is ``sample`` or ``population``; skewness and kurtosis use that deviation and
    divide by n. ``quartiles`` is ``index`` (sorted values at n/4 and 3n/4) or ``avg4``
    (averaged with the value before when n divides by 4; the ends when n < 4).
    """
    ranks = {
        **MIDDLE,
        "_q1": lambda n: F.floor(n / 4),
        "_q3": lambda n: F.floor(3 * n / 4),
        "_q1b": lambda n: F.greatest(F.floor(n / 4) - 1, F.lit(0)),
        "_q3b": lambda n: F.greatest(F.floor(3 * n / 4) - 1, F.lit(0)),
        "_first": lambda n: F.lit(0),
        "_last": lambda n: n - 1,
    }
    ranked = ordered.values_at(df, keys, value, ranks)
    sigma = F.stddev_samp(value) if std == "sample" else F.stddev_pop(value)
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.coalesce(sigma, F.lit(0.0)).alias("std_dev"),
        F.stddev_pop(value).alias("_pop"),
        F.skewness(value).alias("_skew"),
        F.kurtosis(value).alias("_kurt"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = moments.alias("m").join(ranked.alias("r"), on) if keys else moments.crossJoin(ranked)
    q1, q3 = F.col("_q1"), F.col("_q3")
    if quartiles == "avg4":
        n = F.col("count")
        q1 = F.when(n < 4, F.col("_first")).when(n % 4 == 0, (F.col("_q1b") + q1) / 2).otherwise(q1)
        q3 = F.when(n < 4, F.col("_last")).when(n % 4 == 0, (F.col("_q3b") + q3) / 2).otherwise(q3)
    # Spark's skewness and kurtosis are in units of the population deviation.
    ratio = F.try_divide(F.col("_pop"), F.col("std_dev"))
    return joined.select(
        *[F.col(f"m.{k}").alias(k) for k in keys],
        "count",
        F.round("mean", R).alias("mean"),
        F.round("std_dev", R).alias("std_dev"),
        "min",
        "max",
        F.round((F.col("_low") + F.col("_high")) / 2, R).alias("median"),
        F.round(q1, R).alias("q1"),
        F.round(q3, R).alias("q3"),
        F.round(F.col("_skew") * F.pow(ratio, 3), R).alias("skewness"),
        F.round((F.col("_kurt") + 3) * F.pow(ratio, 4) - 3, R).alias("kurtosis"),
    )


def query_log_stats(df: DataFrame, keys: Sequence[str] = (), window_seconds: int = 3600) -> DataFrame:
    """Counts, timings, error rate and queries per second of an execution log.

    ``df`` has status, duration_ms, rows_processed and rows_returned.
    """
    keyed = df.withColumn("_all", F.lit(0))
    keys = list(keys) or ["_all"]
    n = F.count(F.lit(1))
    failed = F.count_if(F.col("status") == "Failed")
    totals = keyed.groupBy(*keys).agg(
        n.alias("total_queries"),
        F.count_if(F.col("status") == "Completed").alias("successful_queries"),
        failed.alias("failed_queries"),
        F.round(F.avg("duration_ms"), R).alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.sum("rows_processed").alias("rows_processed"),
        F.sum("rows_returned").alias("rows_returned"),
        F.round(failed / n, R).alias("error_rate"),
        F.round(n / window_seconds, R).alias("throughput_qps"),
    )
    ranked = percentiles(keyed, keys, "duration_ms", (50, 95, 99), round_rank)
    return totals.join(ranked, keys).drop("_all")
