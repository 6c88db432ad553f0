"""Named functions: scalars in SQL, aggregates, and table functions over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.catalog.series_queries import ENSEMBLE, H, LEVELS, P, PAIRS, _MIX, rounded
from sparkscope.functions.registry import Function, default
from sparkscope.model import FLAT_SQL, SERIES_SQL, records, series, table

REC = f"WITH rec AS ({FLAT_SQL}) "


@query(
    "udf_registry",
    "SELECT event_id AS id, value * 2 AS doubled, upper(event_type) AS shout FROM events",
)
def udf_registry(spark, d):
    registry = default()
    registry.add(Function("doubled", "scalar", lambda c: c * 2, "(x DOUBLE) RETURNS DOUBLE RETURN x * 2"))
    registry.add(Function("shout", "scalar", F.upper))
    registry.add(Function("unused", "scalar", F.lower))
    registry.remove("unused")
    registry.register(spark)
    table(spark, d, "events").createOrReplaceTempView("scope_functions")
    out = spark.sql("SELECT event_id AS id, doubled(value) AS doubled, event_type FROM scope_functions")
    return out.select("id", "doubled", registry.call("shout", F.col("event_type")).alias("shout"))


@query(
    "udf_scalar",
    REC
    + """SELECT id, coalesce(CASE WHEN k % 6 = 2 THEN concat('own-', t_region) END, a_service) AS service_name, span_name AS operation_name, trace_id, span_id, a_url AS url, t_region AS region, metric_name FROM rec""",
)
def udf_scalar(spark, d):
    registry = default()
    registry.register(spark)
    docs = records(spark, d).select(
        "id", F.to_json(F.struct("trace", "service", "attributes", "tags")).alias("doc"), F.to_json("metric").alias("metric_doc")
    )
    docs.createOrReplaceTempView("scope_docs")
    out = spark.sql(
        """SELECT id, doc, metric_doc, extract_service_name(doc) AS service_name, extract_operation_name(doc) AS operation_name,
        extract_trace_id(doc) AS trace_id, extract_span_id(doc) AS span_id FROM scope_docs"""
    )
    return out.select(
        "id",
        "service_name",
        "operation_name",
        "trace_id",
        "span_id",
        registry.call("extract_attributes", F.col("doc"))["url"].alias("url"),
        registry.call("extract_tags", F.col("doc"))["region"].alias("region"),
        registry.call("parse_metric", F.col("metric_doc"))["name"].alias("metric_name"),
    )


@query(
    "round_to_interval",
    "SELECT event_id AS id, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS slot FROM events",
)
def round_to_interval(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), default().call("round_to_interval", F.col("ts"), 300).alias("slot"))


_UDAF = """SELECT {key} AS k, round(avg({v}), 6) AS {p}_avg, round(coalesce(stddev_samp({v}), 0), 6) AS {p}_stddev, min({v}) AS {p}_min, max({v}) AS {p}_max, count({v}) AS {p}_count, round(sum({v}), 4) AS {p}_sum,
    max(CASE WHEN i = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) THEN {v} END) AS {p}_p95, max(CASE WHEN i = least(CAST(floor(0.99 * n) AS BIGINT), n - 1) THEN {v} END) AS {p}_p99
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {v}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {t}) GROUP BY {key}"""

_NAMES = ("avg", "stddev", "min", "max", "count", "sum", "p95", "p99")


def _named(df, key, value, prefix):
    out = default().aggregate(df.withColumnRenamed(key, "k"), ["k"], [f"{prefix}_{n}" for n in _NAMES], value)
    out = rounded(out, f"{prefix}_avg", f"{prefix}_stddev")
    return out.withColumn(f"{prefix}_sum", F.round(f"{prefix}_sum", 4))


@query("agg_telemetry_udaf", _UDAF.format(key="event_type", v="value", p="telemetry", t="events"))
def agg_telemetry_udaf(spark, d):
    return _named(table(spark, d, "events"), "event_type", "value", "telemetry")


@query("udaf", _UDAF.format(key="l_returnflag", v="l_extendedprice", p="custom", t="lineitem"))
def udaf(spark, d):
    return _named(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "custom")


@query(
    "udf_ts",
    P
    + LEVELS
    + H
    + f""", en AS ({ENSEMBLE}) SELECT series, 'trend' AS what, round(slope, 8) AS value FROM f UNION ALL SELECT series, 'anomalies', CAST(count(*) AS DOUBLE) FROM en GROUP BY series
    UNION ALL SELECT series, 'forecast', round({_MIX}, 5) FROM g, h WHERE step = 3 UNION ALL SELECT series, 'mean', round(mean, 6) FROM f""",
)
def udf_ts(spark, d):
    registry, s = default(), series(spark, d)
    trend = registry.call("analyze_trend", s).select("series", F.lit("trend").alias("what"), F.round("slope", 8).alias("value"))
    found = registry.call("detect_anomaly", s).groupBy("series").agg(
        F.lit("anomalies").alias("what"), F.count(F.lit(1)).cast("double").alias("value")
    )
    ahead = registry.call("forecast", s, horizon=3).filter("step = 3")
    ahead = ahead.select("series", F.lit("forecast").alias("what"), F.round("predicted", 5).alias("value"))
    mean = registry.call("time_series_agg", s).select("series", F.lit("mean").alias("what"), F.col("mean").alias("value"))
    return trend.unionByName(found).unionByName(ahead).unionByName(mean)


@query(
    "udf_analytics",
    P
    + H
    + f""", m AS (SELECT series, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS b, avg(value) AS v FROM ({SERIES_SQL}) GROUP BY 1, 2)
    SELECT series, 'strength' AS what, round(abs(slope), 8) AS value FROM f UNION ALL SELECT series, 'intercept', round(intercept, 6) FROM f
    UNION ALL SELECT x.series || '~' || y.series, 'correlation', round(corr(x.v, y.v), 6) FROM m x JOIN m y ON x.b = y.b AND x.series < y.series GROUP BY x.series, y.series
    UNION ALL SELECT series, 'ahead', round(last + CASE WHEN slope > 0.01 THEN 1 WHEN slope < -0.01 THEN -1 ELSE 0 END * abs(slope) * step, 5) FROM f, h WHERE step = 2""",
)
def udf_analytics(spark, d):
    registry, s = default(), series(spark, d)
    shown = lambda df, key, what, value, digits: df.select(
        key.alias("series"), F.lit(what).alias("what"), F.round(value, digits).alias("value")
    )
    out = shown(registry.call("calculate_trend", s), F.col("series"), "strength", "strength", 8)
    out = out.unionByName(shown(registry.call("calculate_regression", s), F.col("series"), "intercept", "intercept", 6))
    pairs = registry.call("calculate_correlation", s, PAIRS, bucket_seconds=12 * 3600)
    out = out.unionByName(shown(pairs, F.concat_ws("~", "left", "right"), "correlation", "correlation", 6))
    ahead = registry.call("forecast_values", s, horizon=2).filter("step = 2")
    return out.unionByName(shown(ahead, F.col("series"), "ahead", "predicted", 5))


@query("udf_cluster_analysis")
def udf_cluster_analysis(spark, d):
    return default().call("cluster_analysis", series(spark, d), k=3)
