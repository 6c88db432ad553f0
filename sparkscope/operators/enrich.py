"""Enrichment: time parts, service and environment names, rules, lookups, sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import transforms as tr
from sparkscope.operators.filters import resolve
from sparkscope.session import small_side


def time_parts(df: DataFrame, as_of: Column, column: str = "timestamp") -> DataFrame:
    """Age in seconds, hour, weekday (Monday is 0) and weekend flag."""
    return df.withColumns(
        {
            "age_seconds": F.unix_seconds(F.timestamp_micros(F.unix_micros(as_of) - F.unix_micros(column))),
            "hour_of_day": F.hour(column),
            "day_of_week": F.weekday(column),
            "is_weekend": F.weekday(column) >= 5,
        }
    )


def time_struct(ts: Column) -> Column:
    """Calendar parts of a time as one struct."""
    return F.struct(
        F.unix_millis(ts).alias("timestamp"),
        tr.rfc3339(ts).alias("iso_string"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.day(ts).alias("day"),
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
        F.second(ts).alias("second"),
        F.lit("UTC").alias("timezone"),
    )


def lookup(df: DataFrame, source: str, table: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Left-join ``table`` on ``key``; broadcast only when its size is small.

    The dictionary keeps one row per key, so the join adds no rows.
    """
    pairs = table.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias(target))
    return df.join(small_side(pairs), F.col(source) == F.col("_key"), "left").drop("_key")


def _mapped(df: DataFrame, found: Column, mapping: DataFrame | None, default: str | None, target: str) -> DataFrame:
    df = df.withColumn("_found", found)
    name = F.col("_found")
    if mapping is not None:
        df = lookup(df, "_found", mapping, "from", "to", "_mapped")
        name = F.coalesce("_mapped", "_found")
    if default is not None:
        name = F.coalesce(name, F.lit(default))
    return df.withColumn("attributes", tr.put(F.col("attributes"), target, name)).drop("_found", "_mapped")


def service_found() -> Column:
    """The first service name among attributes, tags, resource and service."""
    return F.coalesce(
        F.col("attributes")["service.name"],
        F.col("attributes")["service"],
        F.col("tags")["service.name"],
        F.col("tags")["service"],
        F.col("resource.attributes")["service.name"],
        F.col("service.name"),
    )


def environment_found() -> Column:
    """The first environment among attributes, tags and resource."""
    return F.coalesce(
        F.col("attributes")["environment"],
        F.col("attributes")["env"],
        F.col("tags")["environment"],
        F.col("tags")["env"],
        F.col("resource.attributes")["environment"],
    )


def correlation_id() -> Column:
    """The record's correlation id, or one that follows from its id."""
    return F.coalesce(F.col("attributes")["correlation_id"], F.sha2(F.col("id"), 256))


def service(df: DataFrame, mapping: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """Set attribute ``service.name`` to the first service name found, mapped, or the default.

    ``mapping`` has the columns ``from`` and ``to``.
    """
    return _mapped(df, service_found(), mapping, default, "service.name")


def environment(df: DataFrame, mapping: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """Set attribute ``environment`` to the first environment found, mapped, or the default."""
    return _mapped(df, environment_found(), mapping, default, "environment")


@dataclass(frozen=True)
class EnrichRule:
    """copy / regex / static / expression / transform of ``source`` into attribute ``target``.

    ``argument`` is the pattern of a regex rule, or the function of a transform rule.
    """

    target: str
    kind: str
    source: str
    argument: object = None
    default: str | None = None
    enabled: bool = True


def _rule_value(rule: EnrichRule) -> Column:
    if rule.kind == "static":
        return F.lit(rule.source)
    if rule.kind == "expression":
        return F.expr(rule.source).cast("string")
    field = resolve(rule.source)
    if rule.kind == "copy":
        return field
    if rule.kind == "regex":
        return tr.group1(field, str(rule.argument))
    if rule.kind == "transform":
        return rule.argument(field)
    raise ValueError(f"unknown enrichment rule: {rule.kind}")


def by_rules(df: DataFrame, rules: Sequence[EnrichRule]) -> DataFrame:
    """Apply the rules in order; an empty result takes the rule's default, else sets nothing.

    Rules that don't name an earlier one's target are set in one rebuild of the map.
    """
    held: dict[str, Column] = {}
    for rule in rules:
        if not rule.enabled:
            continue
        reads = f"{rule.source} {rule.argument}" if rule.kind != "static" else ""
        if rule.target in held or any(target in reads for target in held):
            df, held = df.withColumn("attributes", tr.put_all(F.col("attributes"), held)), {}
        value = F.nullif(_rule_value(rule), F.lit(""))
        if rule.default is not None:
            value = F.coalesce(value, F.lit(rule.default))
        held[rule.target] = value.cast("string")
    return df.withColumn("attributes", tr.put_all(F.col("attributes"), held)) if held else df


def is_error(status: Column) -> Column:
    return F.coalesce(status == "error", F.lit(False))


def response_class(milliseconds: Column) -> Column:
    return (
        F.when(milliseconds.isNull(), "unknown")
        .when(milliseconds < 100, "fast")
        .when(milliseconds < 500, "medium")
        .otherwise("slow")
    )


def correlation(df: DataFrame) -> DataFrame:
    """Fill attribute ``correlation_id`` where it is missing; the same record gets the same id."""
    return df.withColumn("attributes", tr.put(F.col("attributes"), "correlation_id", correlation_id()))


def chance(key: Column) -> Column:
    """A stable draw in [0, 1) per key, so that retries decide the same way."""
    return F.pmod(F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("bigint"), F.lit(10_000)) / 10_000


def sample(df: DataFrame, rate: float | Column, key: str = "id") -> DataFrame:
    """Keep each row with probability ``rate``."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return df.filter(chance(F.col(key)) < rate)


def severity_rate() -> Column:
    """Metrics, events and errors in full; warnings at one half; other logs and spans at a tenth."""
    return (
        F.when(F.col("record_type") == "Trace", F.when(F.col("trace.status_code") == "Error", 1.0).otherwise(0.1))
        .when(
            F.col("record_type") == "Log",
            F.when(F.col("log.level").isin("Error", "Fatal"), 1.0)
            .when(F.col("log.level") == "Warn", 0.5)
            .otherwise(0.1),
        )
        .otherwise(1.0)
    )
