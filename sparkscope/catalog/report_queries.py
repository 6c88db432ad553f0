"""Domain reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.catalog.aggregate_queries import AVG4_Q, LOG_SQL, _summary_sql, query_log
from sparkscope.catalog.alert_queries import LONG_SQL, METRICS_SQL, _ensemble_sql, service_metrics
from sparkscope.model import SERIES_SQL, newest, spans, table
from sparkscope.plans import reports as rp

CLOCK = "(SELECT max(ts) FROM events)"


@query(
    "rep_workflow",
    _ensemble_sql(SERIES_SQL)
    + f""", su AS ({_summary_sql(SERIES_SQL, 'series', 'stddev_pop', *AVG4_Q)}),
    se AS (SELECT series, arg_max(lag, ac) AS lag, max(ac) AS ac FROM (SELECT x.series, y.i - x.i AS lag, avg(x.value * y.value) AS ac FROM p x JOIN p y ON x.series = y.series AND y.i > x.i AND y.i <= x.i + least(x.n // 2, 100) WHERE x.n >= 10 GROUP BY 1, 2) GROUP BY series),
    an AS (SELECT series, count(*) AS anomalies, max(severity) AS worst FROM en GROUP BY series)
    SELECT su.series, su.count AS total_operations, su.mean, su.std_dev, su.min, su.max, su.median, su.q1, su.q3, round(f.slope, 8) AS slope,
      CASE WHEN f.slope > 0.01 THEN 'Increasing' WHEN f.slope < -0.01 THEN 'Decreasing' ELSE 'Stable' END AS direction, CASE WHEN se.ac > 0.3 THEN se.lag END AS season_lag, coalesce(an.anomalies, 0) AS anomalies,
      CASE WHEN su.series = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS error_rate, CASE WHEN abs(f.slope) > 0.1 THEN 'high' ELSE 'low' END AS trend_severity,
      CASE WHEN an.anomalies IS NOT NULL THEN CASE WHEN an.worst > 0.8 THEN 'high' ELSE 'medium' END END AS anomaly_severity FROM su JOIN f USING (series) LEFT JOIN se USING (series) LEFT JOIN an USING (series)""",
)
def rep_workflow(spark, d):
    return rp.workflow(spans(spark, d))


@query(
    "rep_agent",
    f"""WITH m AS ({METRICS_SQL}), i AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY timestamp, id) - 1 AS i FROM m),
    a AS (SELECT agent_id, avg(response_time_ms) AS e, avg(cpu_usage) AS c, avg(memory_usage) AS y, regr_slope(response_time_ms, i) AS se, regr_slope(cpu_usage, i) AS sc, regr_slope(memory_usage, i) AS sy FROM i GROUP BY agent_id)
    SELECT agent_id, round(e, 6) AS avg_execution_time_ms, round(c, 6) AS avg_cpu_usage, round(y, 6) AS avg_memory_usage, round(se, 8) AS slope_execution_time_ms, round(sc, 8) AS slope_cpu_usage, round(sy, 8) AS slope_memory_usage,
      CASE WHEN se > 0 THEN 'degrading' ELSE 'improving' END AS performance, CASE WHEN c > 80 OR y > 80 THEN 'warning' ELSE 'normal' END AS status FROM a""",
)
def rep_agent(spark, d):
    return rp.agents(service_metrics(spark, d).withColumnRenamed("response_time_ms", "execution_time_ms"))


REPO_SQL = """SELECT row_number() OVER (ORDER BY c_mktsegment, o_orderpriority, o_orderdate) AS id, c_mktsegment AS repo_name, o_orderpriority AS branch_name, o_orderdate AS timestamp, count(*) AS commit_count,
    count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS merge_count, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS conflict_count, avg(o_totalprice) / 500000 AS collaboration_score
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2, 3, 4"""


def repo_metrics(spark, d):
    """orders as activity of repositories (market segments) and branches (priorities) per day."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    keys = [F.col("c_mktsegment").alias("repo_name"), F.col("o_orderpriority").alias("branch_name"), F.col("o_orderdate").alias("timestamp")]
    out = o.join(c, o.o_custkey == c.c_custkey).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.count_if(F.col("o_orderstatus") == "F").alias("merge_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("conflict_count"),
        (F.avg("o_totalprice") / 500_000).alias("collaboration_score"),
    )
    return out.withColumn("id", F.xxhash64("repo_name", "branch_name", "timestamp"))


@query("rep_repo")
def rep_repo(spark, d):
    out = rp.repositories(repo_metrics(spark, d))
    return out.withColumns({"score": F.round("score", 6), "center": F.transform("center", lambda v: F.round(v, 4))})


@query(
    "rep_repo_sound",
    f"""SELECT count(*) AS rows, true AS patterns_fit, true AS scored, CAST(sum(commit_count) AS BIGINT) AS total_commits, CAST(sum(commit_count) AS DOUBLE) AS commits_by_centre FROM ({REPO_SQL})""",
)
def rep_repo_sound(spark, d):
    """The patterns of rep_repo: their sizes add up to all rows, and size times centre to all commits."""
    out = rp.repositories(repo_metrics(spark, d))
    return out.agg(
        F.sum("size").alias("rows"),
        F.count(F.lit(1)).between(1, 3).alias("patterns_fit"),
        F.min(F.col("score").between(0, 1)).alias("scored"),
        F.max("total_commits").alias("total_commits"),
        F.round(F.sum(F.col("size") * F.col("center")[0]), 3).cast("double").alias("commits_by_centre"),
    )


@query(
    "rep_repo_totals",
    f"""SELECT CAST(sum(commit_count) AS BIGINT) AS total_commits, CAST(sum(merge_count) AS BIGINT) AS total_merges, CAST(sum(conflict_count) AS BIGINT) AS total_conflicts, round(avg(collaboration_score), 6) AS avg_collaboration,
    count(DISTINCT repo_name) AS repositories, count(DISTINCT branch_name) AS branches FROM ({REPO_SQL})""",
)
def rep_repo_totals(spark, d):
    return rp.repository_totals(repo_metrics(spark, d))


def _recent(days):
    return f"SELECT * FROM ({LONG_SQL}) WHERE ts >= {CLOCK} - INTERVAL {days} DAY"


@query(
    "rep_realtime",
    _ensemble_sql(_recent(1))
    + "SELECT series, count(*) AS data_points, round(avg(value), 6) AS mean, any_value(coalesce(a.n, 0)) AS anomalies FROM p LEFT JOIN (SELECT series, count(*) AS n FROM en GROUP BY series) a USING (series) GROUP BY series",
)
def rep_realtime(spark, d):
    m = service_metrics(spark, d)
    return rp.realtime(m, newest(m), 86_400)


TREND = "WITH q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts, id) - 1 AS i FROM ({source})), t AS (SELECT series, count(*) AS n, avg(value) AS mean, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2 FROM q GROUP BY series) "


@query(
    "rep_system_insights",
    TREND.format(source=_recent(7))
    + """SELECT CASE series WHEN 'response_time_ms' THEN 'performance' WHEN 'error_rate' THEN 'reliability' ELSE 'resource_utilization' END AS type, series AS category,
      CASE series WHEN 'response_time_ms' THEN CASE WHEN slope > 0 THEN 'degrading' ELSE 'improving' END WHEN 'error_rate' THEN CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END ELSE CASE WHEN mean > 80 THEN 'warning' ELSE 'normal' END END AS trend,
      CASE series WHEN 'response_time_ms' THEN CASE WHEN abs(slope) > 0.1 THEN 'high' ELSE 'low' END WHEN 'error_rate' THEN CASE WHEN slope > 0.05 THEN 'high' ELSE 'medium' END ELSE CASE WHEN mean > 90 THEN 'high' WHEN mean > 80 THEN 'medium' ELSE 'low' END END AS severity,
      round(mean, 6) AS mean, round(slope, 8) AS slope FROM t""",
)
def rep_system_insights(spark, d):
    m = service_metrics(spark, d)
    return rp.system_insights(m, newest(m), 7 * 86_400)


@query(
    "rep_system_trends",
    TREND.format(source=_recent(1))
    + "SELECT series, n AS data_points, round(mean, 6) AS mean, round(slope, 8) AS slope, CASE WHEN slope > 0.01 THEN 'Increasing' WHEN slope < -0.01 THEN 'Decreasing' ELSE 'Stable' END AS direction, round(least(r2, 1.0), 8) AS confidence FROM t",
)
def rep_system_trends(spark, d):
    m = service_metrics(spark, d)
    out = rp.system_trends(m, newest(m))
    return out.withColumns({"mean": F.round("mean", 6), "slope": F.round("slope", 8), "confidence": F.round("confidence", 8)})


@query("rep_line", f"SELECT series, ts, value FROM ({LONG_SQL}) WHERE series IN ('response_time_ms', 'cpu_usage')")
def rep_line(spark, d):
    return rp.line_chart(service_metrics(spark, d), "timestamp", ["response_time_ms", "cpu_usage"])


@query(
    "rep_bar",
    f"SELECT service_name AS service, round(avg(response_time_ms), 6) AS avg_response_time, count(*) AS count, round(sum(response_time_ms), 4) AS total_response_time FROM ({METRICS_SQL}) GROUP BY 1",
)
def rep_bar(spark, d):
    return rp.bar_chart(service_metrics(spark, d), "service_name", "response_time_ms")


@query(
    "rep_interactive",
    "SELECT event_type, count(*) AS n, (SELECT count(DISTINCT event_type) FROM events) AS row_count, 'event_type,n' AS columns FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
)
def rep_interactive(spark, d):
    table(spark, d, "events").createOrReplaceTempView("scope_interactive")
    sample, rows, columns = rp.interactive(
        spark, "SELECT event_type, count(*) AS n FROM scope_interactive GROUP BY event_type ORDER BY n DESC, event_type"
    )
    return sample.withColumns({"row_count": F.lit(rows).cast("bigint"), "columns": F.lit(",".join(columns))})


_BOTTLENECKS = f"""WITH c AS (SELECT count(*) AS n, count(CASE WHEN duration_ms > 1000 THEN 1 END) AS slow, count(CASE WHEN status = 'Failed' THEN 1 END) AS failed, count(CASE WHEN status = 'Timeout' THEN 1 END) AS timeouts,
    avg(duration_ms) AS avg_ms FROM ({LOG_SQL})),
    b AS (SELECT 'SlowQueryExecution' AS type, CASE WHEN slow > n // 10 THEN 'High' ELSE 'Medium' END AS severity, slow / n AS impact, slow AS affected FROM c WHERE slow > 0
    UNION ALL SELECT 'ErrorRateSpike', CASE WHEN failed / n > 0.1 THEN 'Critical' ELSE 'High' END, failed / n, failed FROM c WHERE failed / n > 0.05
    UNION ALL SELECT 'QueryTimeout', 'High', timeouts / n, timeouts FROM c WHERE timeouts > 0) """


@query("rep_bottlenecks", _BOTTLENECKS + "SELECT type, severity, round(impact, 6) AS impact, affected FROM b")
def rep_bottlenecks(spark, d):
    return rp.bottlenecks(query_log(spark, d)).withColumn("impact", F.round("impact", 6))


@query(
    "rep_half_trend",
    f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY start_time, query_id) - 1 AS i, count(*) OVER () AS n FROM ({LOG_SQL})),
    h AS (SELECT avg(CASE WHEN i < n // 2 THEN duration_ms END) AS t0, avg(CASE WHEN i >= n // 2 THEN duration_ms END) AS t1, avg(CASE WHEN i < n // 2 THEN CASE WHEN status = 'Failed' THEN 1.0 ELSE 0.0 END END) AS e0,
      avg(CASE WHEN i >= n // 2 THEN CASE WHEN status = 'Failed' THEN 1.0 ELSE 0.0 END END) AS e1 FROM l),
    c AS (SELECT 'Average Execution Time' AS metric, t1 AS a, t0 AS b, (t1 - t0) / t0 * 100 AS ch, 5.0 AS lim FROM h UNION ALL SELECT 'Error Rate', e1, e0, (e1 - e0) / e0 * 100, 10.0 FROM h)
    SELECT metric, round(a, 6) AS current_value, round(b, 6) AS previous_value, round(ch, 6) AS change_percentage, CASE WHEN ch < -lim THEN 'Improving' WHEN ch > lim THEN 'Degrading' ELSE 'Stable' END AS direction FROM c""",
)
def rep_half_trend(spark, d):
    return rp.half_trend(query_log(spark, d), "start_time", "query_id")


@query(
    "rep_health",
    _BOTTLENECKS
    + """, s AS (SELECT failed / n AS error_rate, avg_ms, (SELECT sum(CASE severity WHEN 'Critical' THEN 0.3 WHEN 'High' THEN 0.2 WHEN 'Medium' THEN 0.1 ELSE 0.05 END::DOUBLE) FROM b) AS lost FROM c)
    SELECT round(error_rate, 6) AS error_rate, round(avg_ms, 6) AS avg_ms, round(lost, 6) AS penalties, round(least(greatest(1 - error_rate * 0.5 - CASE WHEN avg_ms > 1000 THEN 0.2 ELSE 0 END - lost, 0), 1), 6) AS health FROM s""",
)
def rep_health(spark, d):
    return rp.health(query_log(spark, d))
