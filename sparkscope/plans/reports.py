"""Domain reports, composed from aggregates and series analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkscope.operators import aggregates as ag, anomalies, cluster, ordered, series as ts
from sparkscope.session import stage

METRICS = ("response_time_ms", "error_rate", "cpu_usage", "memory_usage")


def service_hours(spans: DataFrame) -> DataFrame:
    """Requests, error rate, mean, p95 and anomalies per service and hour.

    An anomaly is a request more than three sample deviations from its service's mean.
    """
    keys = ["service_name", "hour"]
    ms, n = F.col("duration_ms"), F.col("n")
    # One pass over the spans: equal durations are counted, and all numbers follow from the counts.
    counts = spans.groupBy("service_name", F.date_trunc("hour", "timestamp").alias("hour"), "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors")
    )
    counts = stage(counts, "durations")
    known = F.sum(F.when(ms.isNotNull(), n))
    means = counts.groupBy("service_name").agg((F.sum(ms * n) / known).alias("_m"))
    around = counts.join(means, "service_name")
    off = F.col("duration_ms") - F.col("_m")
    spread = around.groupBy("service_name").agg(F.sqrt(F.try_divide(F.sum(off * off * n), known - 1)).alias("_sd"))
    odd = F.abs(off) > 3 * F.col("_sd")
    totals = (
        around.join(spread, "service_name")
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("requests"),
            F.round(F.sum("errors") / F.sum("n"), 6).alias("error_rate"),
            F.round(F.sum(ms * n) / known, 6).alias("avg_ms"),
            F.sum(F.when(odd, n).otherwise(0)).alias("anomalies"),
        )
    )
    p95 = ordered.values_at(counts, keys, "duration_ms", {"p95_ms": ag.floor_rank(95)}, weight="n")
    return totals.join(p95, keys)


def long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key and metric: the metric's name in ``metric``, its number in ``value``.

    Text is read as a number, else it counts as 0.0.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), number(m).alias("value")) for m in metrics])
    return df.select(*keys, F.inline(entries))


def workflow(spans: DataFrame) -> DataFrame:
    """Per service: duration summary, trend, seasonality, anomalies, error rate and insight levels."""
    points = spans.select(
        F.col("service_name").alias("series"), F.col("timestamp").alias("ts"), "id", F.col("duration_ms").alias("value")
    )
    stats = ag.summary(points, ["series"], "value", "population", "avg4")
    trend = ts.trend(points).select("series", "slope", "direction", "confidence")
    season = ts.seasonality(points).select("series", F.col("lag").alias("season_lag"))
    found = anomalies.ensemble(points).groupBy("series").agg(
        F.count(F.lit(1)).alias("anomalies"), F.max("severity").alias("_worst")
    )
    errors = spans.groupBy(F.col("service_name").alias("series")).agg(
        ag.error_share(F.col("status_code").cast("string")).alias("error_rate")
    )
    joined = stats.join(errors, "series")
    for part in (trend, season, found):
        joined = joined.join(part, "series", "left")
    return joined.select(
        "series",
        F.col("count").alias("total_operations"),
        "mean",
        "std_dev",
        "min",
        "max",
        "median",
        "q1",
        "q3",
        F.round("slope", 8).alias("slope"),
        "direction",
        "season_lag",
        F.coalesce("anomalies", F.lit(0)).alias("anomalies"),
        F.round("error_rate", 6).alias("error_rate"),
        F.when(F.abs("slope") > 0.1, "high").otherwise("low").alias("trend_severity"),
        F.when(F.col("anomalies").isNotNull(), F.when(F.col("_worst") > 0.8, "high").otherwise("medium")).alias(
            "anomaly_severity"
        ),
    )


def agents(metrics: DataFrame) -> DataFrame:
    """Per agent: means and trends of execution time, cpu and memory, and warnings above 80 %.

    ``metrics`` has timestamp, id, agent_id, execution_time_ms, cpu_usage and memory_usage.
    """
    names = ("execution_time_ms", "cpu_usage", "memory_usage")
    melted = long(metrics, ["agent_id", "timestamp", "id"], names)
    points = melted.select(
        F.concat_ws("/", "agent_id", "metric").alias("series"), F.col("timestamp").alias("ts"), "id", "value", "agent_id", "metric"
    )
    fit = ts.regression(ts.index(points.select("series", "ts", "id", "value"))).select("series", "slope")
    means = points.groupBy("agent_id", "metric", "series").agg(F.avg("value").alias("mean"))
    wide = means.join(fit, "series").groupBy("agent_id")
    pick = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    out = wide.agg(
        *[F.round(pick(m, "mean"), 6).alias(f"avg_{m}") for m in names],
        *[F.round(pick(m, "slope"), 8).alias(f"slope_{m}") for m in names],
    )
    busy = (F.col("avg_cpu_usage") > 80) | (F.col("avg_memory_usage") > 80)
    return out.withColumns(
        {
            "performance": F.when(F.col("slope_execution_time_ms") > 0, "degrading").otherwise("improving"),
            "status": F.when(busy, "warning").otherwise("normal"),
        }
    )


def repository_totals(metrics: DataFrame) -> DataFrame:
    """Commits, merges, conflicts, mean collaboration, and the numbers of repositories and branches."""
    return metrics.agg(
        F.sum("commit_count").alias("total_commits"),
        F.sum("merge_count").alias("total_merges"),
        F.sum("conflict_count").alias("total_conflicts"),
        F.round(F.avg("collaboration_score"), 6).alias("avg_collaboration"),
        F.countDistinct("repo_name").alias("repositories"),
        F.countDistinct("branch_name").alias("branches"),
    )


def repositories(metrics: DataFrame, clusters: int = 3) -> DataFrame:
    """The repository totals next to each collaboration pattern: a cluster of (commits, merges, score)."""
    points = metrics.select(
        "id",
        F.array(
            F.col("commit_count").cast("double"), F.col("merge_count").cast("double"), F.col("collaboration_score")
        ).alias("x"),
    )
    patterns = cluster.summary(cluster.kmeans(points, clusters))
    return patterns.crossJoin(F.broadcast(repository_totals(metrics)))


def realtime(metrics: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Mean and anomaly count of each metric over the last ``seconds``."""
    recent = metrics.filter(F.unix_micros("timestamp") >= F.unix_micros(as_of) - seconds * 1_000_000)
    points = long(recent, ["timestamp", "id"], METRICS).select(
        F.col("metric").alias("series"), F.col("timestamp").alias("ts"), "id", "value"
    )
    means = points.groupBy("series").agg(F.count(F.lit(1)).alias("data_points"), F.round(F.avg("value"), 6).alias("mean"))
    found = anomalies.ensemble(points).groupBy("series").agg(F.count(F.lit(1)).alias("anomalies"))
    return means.join(found, "series", "left").fillna(0, ["anomalies"])


def system_trends(metrics: DataFrame, as_of: Column, seconds: int = 86_400) -> DataFrame:
    """Points, mean, slope and direction of each metric over the last ``seconds``."""
    recent = metrics.filter(F.unix_micros("timestamp") >= F.unix_micros(as_of) - seconds * 1_000_000)
    points = long(recent, ["timestamp", "id"], METRICS).select(
        F.col("metric").alias("series"), F.col("timestamp").alias("ts"), "id", "value"
    )
    means = points.groupBy("series").agg(F.count(F.lit(1)).alias("data_points"), F.avg("value").alias("mean"))
    return means.join(ts.trend(points).select("series", "slope", "direction", "confidence"), "series", "left")


def system_insights(metrics: DataFrame, as_of: Column, seconds: int = 3_600) -> DataFrame:
    """What the last ``seconds`` say about response times, errors and resources, with a severity each."""
    rows = system_trends(metrics, as_of, seconds)
    slope, mean, name = F.col("slope"), F.col("mean"), F.col("series")
    trend = (
        F.when(name == "response_time_ms", F.when(slope > 0, "degrading").otherwise("improving"))
        .when(name == "error_rate", F.when(slope > 0, "increasing").otherwise("decreasing"))
        .otherwise(F.when(mean > 80, "warning").otherwise("normal"))
    )
    severity = (
        F.when(name == "response_time_ms", F.when(F.abs(slope) > 0.1, "high").otherwise("low"))
        .when(name == "error_rate", F.when(slope > 0.05, "high").otherwise("medium"))
        .otherwise(F.when(mean > 90, "high").when(mean > 80, "medium").otherwise("low"))
    )
    kind = F.when(name == "response_time_ms", "performance").when(name == "error_rate", "reliability")
    return rows.select(
        F.coalesce(kind, F.lit("resource_utilization")).alias("type"),
        name.alias("category"),
        trend.alias("trend"),
        severity.alias("severity"),
        F.round(mean, 6).alias("mean"),
        F.round(slope, 8).alias("slope"),
    )


def line_chart(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """Long (series, ts, value) rows for a line chart."""
    return long(df, [time], columns).select(F.col("metric").alias("series"), F.col(time).alias("ts"), "value")


def bar_chart(df: DataFrame, service: str, value: str) -> DataFrame:
    """Mean, count and total per service for a bar chart."""
    number = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return df.groupBy(F.coalesce(service, F.lit("unknown")).alias("service")).agg(
        F.round(F.avg(number), 6).alias("avg_response_time"),
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(number), 4).alias("total_response_time"),
    )


def interactive(spark: SparkSession, sql: str, rows: int = 10) -> tuple[DataFrame, int, list[str]]:
    """Any SQL: a sample of its rows, how many there are, and its columns."""
    df = spark.sql(sql)
    return df.limit(rows), df.count(), df.columns


# -- execution logs ----------------------------------------------------------------------


def bottlenecks(log: DataFrame, slow_ms: int = 1_000, error_threshold: float = 0.05) -> DataFrame:
    """Slow, failing and timed-out queries of a log, each with its number, impact and severity."""
    n = F.count(F.lit(1))
    counts = log.agg(
        n.alias("n"),
        F.count_if(F.coalesce(F.col("duration_ms"), F.lit(0)) > slow_ms).alias("slow"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.count_if(F.col("status") == "Timeout").alias("timeouts"),
    )
    entry = lambda shown, kind, severity, hits: F.when(
        shown,
        F.struct(
            F.lit(kind).alias("type"), severity.alias("severity"), (hits / F.col("n")).alias("impact"), hits.alias("affected")
        ),
    )
    slow, failed, timeouts = F.col("slow"), F.col("failed"), F.col("timeouts")
    share = failed / F.col("n")
    found = F.array(
        entry(
            slow > 0,
            "SlowQueryExecution",
            F.when(slow > F.floor(F.col("n") / 10), "High").otherwise("Medium"),
            slow,
        ),
        entry(share > error_threshold, "ErrorRateSpike", F.when(share > 0.1, "Critical").otherwise("High"), failed),
        entry(timeouts > 0, "QueryTimeout", F.lit("High"), timeouts),
    )
    return counts.select(F.inline(F.array_compact(found)))


def half_trend(log: DataFrame, time: str, tie: str) -> DataFrame:
    """Mean time and error rate of the later half of a log against the earlier half.

    Better or worse needs a change of 5 % in time or 10 % in errors. Nothing below ten rows.
    """
    keyed = log.withColumn("_all", F.lit(0))
    placed = ordered.indexed(keyed, ["_all"], [time, tie], "i", "n").filter("n >= 10")
    early = F.col("i") < F.floor(F.col("n") / 2)
    late = ~early
    duration = F.coalesce(F.col("duration_ms"), F.lit(0))
    failed = F.when(F.col("status") == "Failed", 1.0).otherwise(0.0)
    mean = lambda part, c: F.avg(F.when(part, c))
    halves = placed.agg(
        F.count(F.lit(1)).alias("_rows"),
        mean(early, duration).alias("t0"),
        mean(late, duration).alias("t1"),
        mean(early, failed).alias("e0"),
        mean(late, failed).alias("e1"),
    ).filter("_rows > 0")

    def change(metric: str, before: str, after: str, limit: float) -> Column:
        moved = F.when(F.col(before) > 0, (F.col(after) - F.col(before)) / F.col(before) * 100).otherwise(0.0)
        verdict = F.when(moved < -limit, "Improving").when(moved > limit, "Degrading").otherwise("Stable")
        return F.struct(
            F.lit(metric).alias("metric"),
            F.round(after, 6).alias("current_value"),
            F.round(before, 6).alias("previous_value"),
            F.round(moved, 6).alias("change_percentage"),
            verdict.alias("direction"),
        )

    both = F.array(change("Average Execution Time", "t0", "t1", 5.0), change("Error Rate", "e0", "e1", 10.0))
    return halves.select(F.inline(both))


# What a bottleneck of each severity takes off the health score.
PENALTIES = {"Critical": 0.3, "High": 0.2, "Medium": 0.1, "Low": 0.05}


def health(log: DataFrame) -> DataFrame:
    """A score from 0 to 1: less for errors, for a mean above a second, and per bottleneck."""
    penalty = F
    for severity, points in PENALTIES.items():
        penalty = penalty.when(F.col("severity") == severity, points)
    lost = bottlenecks(log).agg(F.coalesce(F.sum(penalty), F.lit(0.0)).alias("lost"))
    stats = log.agg(
        F.avg(F.when(F.col("status") == "Failed", 1.0).otherwise(0.0)).alias("error_rate"),
        F.avg("duration_ms").alias("avg_ms"),
    )
    score = 1 - F.col("error_rate") * 0.5 - F.when(F.col("avg_ms") > 1000, 0.2).otherwise(0.0) - F.col("lost")
    return stats.crossJoin(F.broadcast(lost)).select(
        F.round("error_rate", 6).alias("error_rate"),
        F.round("avg_ms", 6).alias("avg_ms"),
        F.round("lost", 6).alias("penalties"),
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("health"),
    )
