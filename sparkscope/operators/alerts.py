"""Alert rules over metric rows, the life of an alert, and alerts from anomalies and thresholds."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkscope.operators import ordered

EPSILON = sys.float_info.epsilon


@dataclass(frozen=True)
class AlertRule:
    """``op``: gt, lt, eq, ne, between (ends included) or outside; ``high`` for the last two."""

    id: str
    metric: str
    op: str
    low: float
    high: float | None = None
    severity: str = "Warning"
    cooldown_seconds: int = 0
    enabled: bool = True


def holds(op: Column, value: Column, low: Column, high: Column) -> Column:
    """Whether a value meets a rule."""
    same = F.abs(value - low) < EPSILON
    return (
        F.when(op == "gt", value > low)
        .when(op == "lt", value < low)
        .when(op == "eq", same)
        .when(op == "ne", ~same)
        .when(op == "between", (value >= low) & (value <= high))
        .when(op == "outside", (value < low) | (value > high))
    )


def judge(metrics: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Rows (metric, ..., value) with every enabled rule on their metric and whether it ``hit``."""
    entries = [
        F.struct(
            F.lit(r.id).alias("rule_id"),
            F.lit(r.metric).alias("rule_metric"),
            F.lit(r.op).alias("op"),
            F.lit(float(r.low)).alias("low"),
            F.lit(None if r.high is None else float(r.high)).cast("double").alias("high"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.cooldown_seconds).cast("bigint").alias("cooldown_seconds"),
        )
        for r in rules
        if r.enabled
    ]
    own = F.filter(F.array(*entries), lambda e: e["rule_metric"] == F.col("metric"))
    ruled = metrics.withColumn("_rule", F.explode(own)).select("*", "_rule.*").drop("_rule", "rule_metric")
    hit = F.coalesce(holds(F.col("op"), F.col("value"), F.col("low"), F.col("high")), F.lit(False))
    return ruled.withColumn("hit", hit)


def episodes(judged: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """One row per alert: when it became active and when it was resolved (null while active).

    An alert starts at a hit without a hit right before it, and is resolved at the next
    miss. ``in_cooldown`` marks one that starts within the rule's cooldown after the
    previous one of its key was resolved.
    """
    placed = ordered.indexed(judged, keys, [ts, tie])
    seen = ordered.framed(placed, keys, {"_before": lambda w: F.lag("hit", 1, False).over(w)}, before=1)
    changes = seen.filter(F.col("hit") != F.col("_before")).drop("i", "_before")
    numbered = ordered.indexed(changes, keys, [ts, tie])
    around = ordered.framed(
        numbered,
        keys,
        {"resolved_at": lambda w: F.lead(ts).over(w), "_ended": lambda w: F.lag(ts).over(w)},
        before=1,
        after=1,
    )
    gap = (F.unix_micros(ts) - F.unix_micros("_ended")) / 1_000_000
    return around.filter("hit").select(
        *keys,
        "severity",
        F.col("value").alias("start_value"),
        F.col("low").alias("threshold"),
        F.col(ts).alias("active_at"),
        "resolved_at",
        F.when(F.col("resolved_at").isNull(), "Active").otherwise("Resolved").alias("status"),
        F.coalesce(gap < F.col("cooldown_seconds"), F.lit(False)).alias("in_cooldown"),
    )


# Alert type and severity of the metrics that raise alerts on anomalies.
ANOMALY_ALERTS = {
    "error_rate": ("error_rate_anomaly", "high"),
    "response_time_ms": ("response_time_anomaly", "medium"),
    "cpu_usage": ("resource_anomaly", "medium"),
    "memory_usage": ("resource_anomaly", "medium"),
}


def from_anomalies(found: DataFrame, metric: str = "series") -> DataFrame:
    """One alert per type with any anomaly: its severity and the number of anomalies."""
    kind, severity = F, F
    for name, (alert, level) in ANOMALY_ALERTS.items():
        kind, severity = kind.when(F.col(metric) == name, alert), severity.when(F.col(metric) == name, level)
    typed = found.select(kind.alias("type"), severity.alias("severity")).filter("type IS NOT NULL")
    return typed.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("count"))


# Severity of a mean above the caller's threshold.
THRESHOLD_SEVERITY = {"error_rate": "high", "response_time_ms": "medium"}


def from_thresholds(metrics: DataFrame, thresholds: dict[str, float], metric: str = "series") -> DataFrame:
    """An alert per metric whose mean is above its threshold."""
    limit, severity = F, F
    for name, value in thresholds.items():
        limit = limit.when(F.col(metric) == name, float(value))
        severity = severity.when(F.col(metric) == name, THRESHOLD_SEVERITY.get(name, "medium"))
    means = metrics.filter(F.col(metric).isin(*thresholds)).groupBy(F.col(metric).alias("metric")).agg(
        F.avg("value").alias("current_value")
    )
    named = means.withColumnRenamed("metric", metric).withColumns({"threshold": limit, "severity": severity})
    over = named.filter(F.col("current_value") > F.col("threshold"))
    return over.select(
        F.lit("threshold_exceeded").alias("type"), F.col(metric).alias("metric"), "severity", "current_value", "threshold"
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    """How many alerts there are, and of which severity."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"), of("high").alias("high"), of("medium").alias("medium"), of("low").alias("low")
    )
