"""Alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import table
from sparkscope.operators import alerts as al, anomalies, rules
from sparkscope.operators.alerts import AlertRule
from sparkscope.plans import reports as rp

HOURLY = """SELECT 'avg_ms' AS metric, event_type, date_trunc('hour', ts) AS ts, epoch_us(date_trunc('hour', ts)) // 3600000000 AS seq, avg(value) AS value FROM events GROUP BY 2, 3, 4
    UNION ALL SELECT 'requests', event_type, date_trunc('hour', ts), epoch_us(date_trunc('hour', ts)) // 3600000000, CAST(count(*) AS DOUBLE) FROM events GROUP BY 2, 3, 4"""

RULES = [
    AlertRule("slow", "avg_ms", "gt", 60, severity="Warning", cooldown_seconds=4 * 3600),
    AlertRule("fast", "avg_ms", "lt", 10, severity="Info"),
    AlertRule("odd", "avg_ms", "outside", 5, 90, severity="Critical"),
    AlertRule("two", "requests", "eq", 2, severity="Info"),
    AlertRule("not_three", "requests", "ne", 3, severity="Info", cooldown_seconds=7200),
    AlertRule("busy", "requests", "between", 4, 6, severity="Emergency"),
    AlertRule("off", "requests", "gt", 0, enabled=False),
]

_RULE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.id}', '{r.metric}', '{r.op}', {float(r.low)}::DOUBLE, {'NULL' if r.high is None else float(r.high)}::DOUBLE, '{r.severity}', {r.cooldown_seconds})"
    for r in RULES
    if r.enabled
) + ") r(rule_id, metric, op, low, high, severity, cooldown_seconds)"

JUDGED = f"""WITH m AS ({HOURLY}), r AS ({_RULE_SQL}), j AS (SELECT m.*, r.* EXCLUDE (metric), CASE op WHEN 'gt' THEN value > low WHEN 'lt' THEN value < low WHEN 'eq' THEN abs(value - low) < 2.220446049250313e-16
    WHEN 'ne' THEN abs(value - low) >= 2.220446049250313e-16 WHEN 'between' THEN value >= low AND value <= high ELSE value < low OR value > high END AS hit FROM m JOIN r ON m.metric = r.metric) """


def hourly(spark, d):
    """Mean time and number of requests per service and hour, as metric rows."""
    h = F.date_trunc("hour", "ts")
    out = table(spark, d, "events").groupBy("event_type", h.alias("ts")).agg(
        F.avg("value").alias("avg_ms"), F.count(F.lit(1)).alias("requests")
    )
    out = out.withColumn("seq", F.call_function("div", F.unix_micros("ts"), F.lit(3_600_000_000)))
    return rp.long(out, ["event_type", "ts", "seq"], ["avg_ms", "requests"])


@query("alert_rules", JUDGED + "SELECT rule_id, event_type, ts, severity, round(value, 6) AS value FROM j WHERE hit")
def alert_rules(spark, d):
    hits = al.judge(hourly(spark, d), RULES).filter("hit")
    return hits.select("rule_id", "event_type", "ts", "severity", F.round("value", 6).alias("value"))


_MANY = """SELECT c_custkey AS rule_id, CASE c_custkey % 2 WHEN 0 THEN 'avg_ms' ELSE 'requests' END AS metric, CASE c_custkey % 6 WHEN 0 THEN 'gt' WHEN 1 THEN 'between' WHEN 2 THEN 'eq' WHEN 3 THEN 'outside' WHEN 4 THEN 'lt' ELSE 'ne' END AS op,
    CASE WHEN c_custkey % 2 = 1 THEN floor(abs(c_acctbal) / 1000) ELSE round(abs(c_acctbal) / 100, 1) END AS low, CASE WHEN c_custkey % 2 = 1 THEN floor(abs(c_acctbal) / 1000) ELSE round(abs(c_acctbal) / 100, 1) END + 2 AS high FROM customer"""


@query(
    "alert_rules_table",
    f"""WITH m AS ({HOURLY}), r AS ({_MANY}), j AS (SELECT rule_id, op, value, CASE op WHEN 'gt' THEN value > low WHEN 'lt' THEN value < low WHEN 'eq' THEN abs(value - low) < 2.220446049250313e-16
    WHEN 'ne' THEN abs(value - low) >= 2.220446049250313e-16 WHEN 'between' THEN value >= low AND value <= high ELSE value < low OR value > high END AS hit FROM m JOIN r ON m.metric = r.metric)
    SELECT CAST(rule_id AS VARCHAR) AS rule_id, op, count(*) AS hits, round(min(value), 6) AS least, round(max(value), 6) AS most FROM j WHERE hit GROUP BY 1, 2""",
)
def alert_rules_table(spark, d):
    """A rule per customer, from a table: how often and how far each hit."""
    c = table(spark, d, "customer")
    key, amount = F.col("c_custkey"), F.abs("c_acctbal")
    low = F.when(key % 2 == 1, F.floor(amount / 1000).cast("double")).otherwise(F.round(amount / 100, 1))
    ops = F.array(*[F.lit(o) for o in ("gt", "between", "eq", "outside", "lt", "ne")])
    many = c.select(
        key.cast("string").alias("id"),
        F.when(key % 2 == 0, "avg_ms").otherwise("requests").alias("metric"),
        F.get(ops, (key % 6).cast("int")).alias("op"),
        low.alias("low"),
        (low + 2).alias("high"),
        F.lit("Info").alias("severity"),
        F.lit(0).cast("bigint").alias("cooldown_seconds"),
        F.lit(True).alias("enabled"),
    )
    found = rules.hits(hourly(spark, d), many, totals=True)
    ends = F.round(F.min("least"), 6).alias("least"), F.round(F.max("most"), 6).alias("most")
    return found.groupBy("rule_id", "op").agg(F.sum("hits").alias("hits"), *ends)


@query(
    "alert_lifecycle",
    JUDGED
    + """, c AS (SELECT *, lag(hit, 1, false) OVER w AS before FROM j WINDOW w AS (PARTITION BY rule_id, event_type ORDER BY ts, seq)), ch AS (SELECT * FROM c WHERE hit <> before),
    e AS (SELECT *, lead(ts) OVER w AS resolved_at, lag(ts) OVER w AS ended FROM ch WINDOW w AS (PARTITION BY rule_id, event_type ORDER BY ts, seq))
    SELECT rule_id, event_type, severity, round(value, 6) AS start_value, low AS threshold, ts AS active_at, resolved_at, CASE WHEN resolved_at IS NULL THEN 'Active' ELSE 'Resolved' END AS status,
      coalesce((epoch_us(ts) - epoch_us(ended)) / 1e6 < cooldown_seconds, false) AS in_cooldown FROM e WHERE hit""",
)
def alert_lifecycle(spark, d):
    judged = al.judge(hourly(spark, d), RULES)
    out = al.episodes(judged, ["rule_id", "event_type"], "ts", "seq")
    return out.withColumn("start_value", F.round("start_value", 6))


def service_metrics(spark, d):
    """events with response time, error, cpu and memory numbers per service."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 10).cast("string")).alias("agent_id"),
        F.col("value").alias("response_time_ms"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("error_rate"),
        ((k * 7 + F.col("user_id")) % 100 + 0.0).alias("cpu_usage"),
        ((k * 3 + F.col("event_id")) % 100 / 4 + 70).alias("memory_usage"),
    )


METRICS_SQL = """SELECT event_id AS id, ts AS timestamp, event_type AS service_name, 'agent-' || CAST(user_id % 10 AS VARCHAR) AS agent_id, value AS response_time_ms,
    CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS error_rate, ((k * 7 + user_id) % 100)::DOUBLE AS cpu_usage, ((k * 3 + event_id) % 100)::DOUBLE / 4 + 70 AS memory_usage
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

LONG_SQL = f"""SELECT id, timestamp AS ts, unnest(['response_time_ms', 'error_rate', 'cpu_usage', 'memory_usage']) AS series, unnest([response_time_ms, error_rate, cpu_usage, memory_usage]) AS value FROM ({METRICS_SQL})"""


def metric_points(spark, d):
    return rp.long(service_metrics(spark, d), ["timestamp", "id"], rp.METRICS).select(
        F.col("metric").alias("series"), F.col("timestamp").alias("ts"), "id", "value"
    )


def _ensemble_sql(source):
    from sparkscope.catalog.series_queries import ENSEMBLE, P
    from sparkscope.model import SERIES_SQL

    return P.replace(SERIES_SQL, source) + f", en AS ({ENSEMBLE}) "


@query(
    "alert_anomaly",
    _ensemble_sql(LONG_SQL)
    + """SELECT CASE series WHEN 'error_rate' THEN 'error_rate_anomaly' WHEN 'response_time_ms' THEN 'response_time_anomaly' ELSE 'resource_anomaly' END AS type,
    CASE series WHEN 'error_rate' THEN 'high' ELSE 'medium' END AS severity, count(*) AS count FROM en GROUP BY 1, 2""",
)
def alert_anomaly(spark, d):
    return al.from_anomalies(anomalies.ensemble(metric_points(spark, d)))


@query(
    "alert_threshold",
    f"""WITH m AS (SELECT series, avg(value) AS v FROM ({LONG_SQL}) GROUP BY series), t AS (SELECT * FROM (VALUES ('error_rate', 0.15::DOUBLE), ('response_time_ms', 40.0::DOUBLE), ('cpu_usage', 95.0::DOUBLE)) t(metric, threshold)),
    a AS (SELECT 'threshold_exceeded' AS type, metric, CASE metric WHEN 'error_rate' THEN 'high' ELSE 'medium' END AS severity, round(v, 6) AS current_value, threshold FROM m JOIN t ON m.series = t.metric WHERE v > threshold)
    SELECT a.*, c.* FROM a, (SELECT count(*) AS total_alerts, count(CASE WHEN severity = 'high' THEN 1 END) AS high, count(CASE WHEN severity = 'medium' THEN 1 END) AS medium, count(CASE WHEN severity = 'low' THEN 1 END) AS low FROM a) c""",
)
def alert_threshold(spark, d):
    over = al.from_thresholds(metric_points(spark, d), {"error_rate": 0.15, "response_time_ms": 40, "cpu_usage": 95})
    counts = F.broadcast(al.severity_counts(over))
    return over.withColumn("current_value", F.round("current_value", 6)).crossJoin(counts)
