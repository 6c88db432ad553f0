"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, SERIES_SQL, SPANS_SQL, flat, records, series, spans, table
from sparkscope.operators import aggregates as ag, rollups
from sparkscope.operators.aggregates import AggregateRule
from sparkscope.session import small_side, stage

REC = f"WITH rec AS ({FLAT_SQL}) "
S = f"WITH s AS ({SERIES_SQL}) "
T = f"WITH t AS ({SPANS_SQL}) "


@query(
    "flagship",
    T
    + """, a AS (SELECT service_name, date_trunc('hour', timestamp) AS hour, duration_ms, status_code,
         avg(duration_ms) OVER (PARTITION BY service_name) AS m, stddev_samp(duration_ms) OVER (PARTITION BY service_name) AS sd FROM t),
      r AS (SELECT *, row_number() OVER (PARTITION BY service_name, hour ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY service_name, hour) AS n FROM a)
    SELECT service_name, hour, count(*) AS requests, round(avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(avg(duration_ms), 6) AS avg_ms,
      max(CASE WHEN i = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) THEN duration_ms END) AS p95_ms, count(CASE WHEN abs(duration_ms - m) > 3 * sd THEN 1 END) AS anomalies FROM r GROUP BY 1, 2""",
)
def flagship(spark, d):
    from sparkscope.plans.reports import service_hours

    return service_hours(spans(spark, d))


@query(
    "agg_core",
    REC
    + """SELECT coalesce(a_env, 'default') AS group_key, count(*) AS count, round(sum(metric_value), 6) AS sum, round(avg(metric_value), 6) AS avg, min(metric_value) AS min, max(metric_value) AS max FROM rec GROUP BY 1
    UNION ALL SELECT 'default', count(*), round(sum(metric_value), 6), round(avg(metric_value), 6), min(metric_value), max(metric_value) FROM rec""",
)
def agg_core(spark, d):
    rec = records(spark, d).withColumn("v", F.col("metric.value"))
    return ag.core(rec, F.col("attributes")["env"], "v").unionByName(ag.core(rec, None, "v"))


@query(
    "agg_numeric_extract",
    REC
    + """SELECT record_type, round(sum(TRY_CAST(a_status AS DOUBLE)), 6) AS sum_status, round(avg(TRY_CAST(a_k AS DOUBLE)), 6) AS avg_k, count(CASE WHEN metric_name = 'business.purchase total' THEN 1 END) AS n_metric,
       round(sum(CASE WHEN metric_name = 'business.purchase total' THEN metric_value END), 4) AS sum_metric, count(TRY_CAST(t_region AS DOUBLE)) AS n_region FROM rec GROUP BY record_type""",
)
def agg_numeric_extract(spark, d):
    named = ag.number_of("business.purchase total")
    return records(spark, d).groupBy("record_type").agg(
        F.round(F.sum(ag.number_of("status_code")), 6).alias("sum_status"),
        F.round(F.avg(ag.number_of("k")), 6).alias("avg_k"),
        F.count(named).alias("n_metric"),
        F.round(F.sum(named), 4).alias("sum_metric"),
        F.count(ag.number_of("region")).alias("n_region"),
    )


@query(
    "agg_rules",
    REC
    + """, g AS (SELECT 'by_env' AS r, coalesce(a_env, 'default') || '|' || t_region AS g, count(*) AS n, CAST(count(*) AS DOUBLE) AS c, round(sum(value), 6) AS s, round(avg(value), 6) AS a FROM rec GROUP BY 2),
       h AS (SELECT 'all' AS r, 'default' AS g, count(*) AS n, max(value) AS mx, min(value) AS mn FROM rec)
    SELECT r AS _rule_name, g AS _group_key, n AS _record_count, 'count' AS function, c AS result FROM g UNION ALL SELECT r, g, n, 'sum', s FROM g UNION ALL SELECT r, g, n, 'avg', a FROM g
    UNION ALL SELECT r, g, n, 'max', mx FROM h UNION ALL SELECT r, g, n, 'min', mn FROM h""",
)
def agg_rules(spark, d):
    rules = [
        AggregateRule("by_env", ["a_env", "t_region"], ["count", "sum", "avg"]),
        AggregateRule("all", [], ["max", "min"]),
        AggregateRule("off", ["k"], ["count"], enabled=False),
    ]
    return ag.by_rules(flat(spark, d), rules)


@query(
    "agg_first_last",
    REC
    + """, g AS (SELECT t_region AS g, count(*) AS n, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM rec GROUP BY 1)
    SELECT 'ends' AS _rule_name, g AS _group_key, n AS _record_count, 'first' AS function, f AS result FROM g UNION ALL SELECT 'ends', g, n, 'last', l FROM g""",
)
def agg_first_last(spark, d):
    return ag.by_rules(flat(spark, d), [AggregateRule("ends", ["t_region"], ["first", "last"])], order=["ts", "event_id"])


@query(
    "agg_filtered",
    REC
    + """SELECT 'errors' AS _rule_name, t_region AS _group_key, count(*) AS _record_count, 'avg' AS function, round(avg(value), 6) AS result FROM rec WHERE event_type = 'error' AND k > 30 GROUP BY 2
    UNION ALL SELECT 'prod', 'default', count(*), 'sum', round(sum(value), 6) FROM rec WHERE a_env = 'prod'""",
)
def agg_filtered(spark, d):
    rules = [
        AggregateRule("errors", ["t_region"], ["avg"], where=(F.col("event_type") == "error") & (F.col("k") > 30)),
        AggregateRule("prod", [], ["sum"], where=F.col("a_env") == "prod"),
    ]
    return ag.by_rules(flat(spark, d), rules)


@query("agg_median", S + "SELECT series, round(median(value), 6) AS median FROM s GROUP BY series")
def agg_median(spark, d):
    return ag.median(series(spark, d), ["series"], "value").withColumn("median", F.round("median", 6))


@query("agg_var_sample", "SELECT l_orderkey, round(coalesce(var_samp(l_quantity), 0), 6) AS var FROM lineitem GROUP BY l_orderkey")
def agg_var_sample(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.coalesce(F.var_samp("l_quantity"), F.lit(0.0)), 6).alias("var")
    )


@query("agg_std_sample", "SELECT l_orderkey, round(coalesce(stddev_samp(l_extendedprice), 0), 4) AS std FROM lineitem GROUP BY l_orderkey")
def agg_std_sample(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.coalesce(F.stddev_samp("l_extendedprice"), F.lit(0.0)), 4).alias("std")
    )


@query("agg_var_pop", S + "SELECT series, round(var_pop(value), 6) AS var FROM s GROUP BY series")
def agg_var_pop(spark, d):
    return series(spark, d).groupBy("series").agg(F.round(F.var_pop("value"), 6).alias("var"))


@query("agg_std_pop", S + "SELECT series, round(stddev_pop(value), 6) AS std FROM s GROUP BY series")
def agg_std_pop(spark, d):
    return series(spark, d).groupBy("series").agg(F.round(F.stddev_pop("value"), 6).alias("std"))


def _ranked(source, key, value, ranks):
    picks = ", ".join(f"max(CASE WHEN i = {r} THEN {value} END) AS {n}" for n, r in ranks.items())
    return f"""SELECT {key}, {picks} FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) GROUP BY {key}"""


_FLOOR = {f"p{p}": f"least(CAST(floor({p} / 100.0 * n) AS BIGINT), n - 1)" for p in (50, 90, 95, 99, 100)}
_ROUND = {f"p{p}": f"CAST(floor({p} / 100.0 * (n - 1) + 0.5) AS BIGINT)" for p in (50, 90, 95, 99)}


@query("agg_pct_floor", _ranked("lineitem", "l_returnflag", "l_extendedprice", _FLOOR))
def agg_pct_floor(spark, d):
    return ag.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (50, 90, 95, 99, 100))


@query("agg_pct_round", _ranked("events", "event_type", "value", _ROUND))
def agg_pct_round(spark, d):
    return ag.percentiles(table(spark, d, "events"), ["event_type"], "value", (50, 90, 95, 99), ag.round_rank)


@query("agg_pct_approx", "SELECT l_returnflag, count(*) AS n, true AS p50_within, true AS p99_within FROM lineitem GROUP BY l_returnflag")
def agg_pct_approx(spark, d):
    """Approximate percentiles, and whether their ranks lie within the promised error of n / 10,000."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    found = rows.groupBy("l_returnflag").agg(
        F.percentile_approx("l_extendedprice", F.lit(0.5), F.lit(10_000)).alias("p50"),
        F.percentile_approx("l_extendedprice", F.lit(0.99), F.lit(10_000)).alias("p99"),
    )
    # One row a flag: sent to the rows, which would else all be sorted in as many tasks as there are flags.
    found = small_side(stage(found, "percentiles"))
    price, n = F.col("l_extendedprice"), F.count(F.lit(1))

    def within(column, q):
        below, up_to = F.count_if(price < F.col(column)), F.count_if(price <= F.col(column))
        slack = n / 10_000 + 1
        return ((below <= q * n + slack) & (up_to >= q * n - slack)).alias(column + "_within")

    return rows.join(found, "l_returnflag").groupBy("l_returnflag").agg(n.alias("n"), within("p50", 0.5), within("p99", 0.99))


@query(
    "agg_rate",
    """SELECT user_id, round(coalesce(count(*) / NULLIF((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) * 3600, 0), 6) AS per_hour FROM events GROUP BY user_id
    UNION ALL SELECT -1 - event_id, 0.0 FROM events""",
)
def agg_rate(spark, d):
    e = table(spark, d, "events")
    keyed = e.select("user_id", "ts").unionByName(e.select((-1 - F.col("event_id")).alias("user_id"), "ts"))
    return keyed.groupBy("user_id").agg(F.round(ag.rate("ts", 3600), 6).alias("per_hour"))


@query(
    "agg_histogram",
    "SELECT event_type, CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM events GROUP BY 1, 2",
)
def agg_histogram(spark, d):
    return ag.histogram(table(spark, d, "events"), ["event_type"], "value", 0.0, 200.0, 20)


@query("agg_cardinality", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def agg_cardinality(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props")
    )


@query(
    "agg_sketch_rollup",
    """SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high,
      true AS p50_within, true AS p99_within, true AS users_within FROM events GROUP BY 1, 2""",
)
def agg_sketch_rollup(spark, d):
    """Hourly summaries, written, merged into days and those into weeks, against the rows: ranks within 3 %, distinct users within 8 %."""
    e = table(spark, d, "events")
    hourly = stage(rollups.rollup(e, "ts", "1 hour", ["event_type"], "value", "user_id"), "rollup")
    weekly = rollups.widen(rollups.widen(hourly, "1 day", ["event_type"]), "7 days", ["event_type"])
    found = weekly.select(
        "window_start", "event_type", "n", "total", "low", "high",
        rollups.quantile(0.5).alias("p50"), rollups.quantile(0.99).alias("p99"), rollups.uniques().alias("users"),
    )
    rows = e.select(F.window("ts", "7 days")["start"].alias("window_start"), "event_type", "value", "user_id").join(found, ["window_start", "event_type"])
    within = lambda c, p: (
        (F.count_if(F.col("value") < F.col(c)) <= (p + 0.03) * F.first("n") + 1) & (F.count_if(F.col("value") <= F.col(c)) >= (p - 0.03) * F.first("n") - 1)
    ).alias(c + "_within")
    users = F.abs(F.first("users") - F.countDistinct("user_id")) <= 0.08 * F.countDistinct("user_id") + 1
    return rows.groupBy("window_start", "event_type").agg(
        F.first("n").alias("n"), F.round(F.first("total"), 4).alias("total"), F.first("low").alias("low"), F.first("high").alias("high"),
        within("p50", 0.5), within("p99", 0.99), users.alias("users_within"),
    )


@query(
    "agg_time_group",
    T + "SELECT date_trunc('minute', timestamp) AS minute, record_type, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms FROM t GROUP BY 1, 2",
)
def agg_time_group(spark, d):
    return spans(spark, d).groupBy(F.date_trunc("minute", "timestamp").alias("minute"), "record_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 6).alias("avg_ms")
    )


@query(
    "agg_error_rate_hourly",
    T + "SELECT date_trunc('hour', timestamp) AS hour, tenant_id, round(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS error_pct FROM t GROUP BY 1, 2",
)
def agg_error_rate_hourly(spark, d):
    errors = F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0))
    return spans(spark, d).groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "tenant_id").agg(
        F.round(F.try_divide(errors * 100.0, F.count(F.lit(1))), 6).alias("error_pct")
    )


@query(
    "agg_error_rate_status",
    REC + "SELECT t_region AS region, round(coalesce(avg(CASE WHEN coalesce(TRY_CAST(a_status AS INTEGER), 200) >= 400 THEN 1.0 ELSE 0.0 END), 0), 6) AS error_rate FROM rec WHERE k % 13 <> 0 GROUP BY 1",
)
def agg_error_rate_status(spark, d):
    status = F.when(F.col("k") % 13 != 0, F.col("a_status"))
    return flat(spark, d).groupBy(F.col("t_region").alias("region")).agg(F.round(ag.error_share(status), 6).alias("error_rate"))


@query("agg_having", T + "SELECT tenant_id, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms FROM t GROUP BY tenant_id HAVING count(*) > 60 AND avg(duration_ms) > 50")
def agg_having(spark, d):
    out = spans(spark, d).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_ms"))
    return out.filter("n > 60 AND avg_ms > 50").withColumn("avg_ms", F.round("avg_ms", 6))


@query("agg_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, year(l_shipdate) AS year FROM lineitem")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("bigint").alias("year")).distinct()


_AGG = "count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY"


def _qty():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty")]


@query("agg_grouping_sets", f"SELECT l_returnflag, l_linestatus, {_AGG} GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def agg_grouping_sets(spark, d):
    l = table(spark, d, "lineitem")
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return l.groupingSets([[a, b], [b], []], a, b).agg(*_qty())


@query("agg_rollup", f"SELECT l_returnflag, l_linestatus, {_AGG} ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(*_qty())


@query("agg_cube", f"SELECT l_returnflag, l_linestatus, {_AGG} CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(*_qty())


def _summary_sql(source, key, std, q1, q3):
    return f"""WITH src AS ({source}), r AS (SELECT {key}, value, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n,
      avg(value) OVER (PARTITION BY {key}) AS m, {std}(value) OVER (PARTITION BY {key}) AS sd FROM src)
    SELECT {key}, count(*) AS count, round(avg(value), 6) AS mean, round(any_value(sd), 6) AS std_dev, min(value) AS min, max(value) AS max, round(median(value), 6) AS median,
      round({q1}, 6) AS q1, round({q3}, 6) AS q3, round(sum(power((value - m) / sd, 3)) / count(*), 6) AS skewness, round(sum(power((value - m) / sd, 4)) / count(*) - 3, 6) AS kurtosis FROM r GROUP BY {key}"""


_at = lambda i: f"max(CASE WHEN i = {i} THEN value END)"
INDEX_Q = (_at("n // 4"), _at("3 * n // 4"))
AVG4_Q = tuple(
    f"CASE WHEN any_value(n) % 4 = 0 THEN ({_at(i + ' - 1')} + {_at(i)}) / 2 ELSE {_at(i)} END" for i in ("n // 4", "3 * n // 4")
)
_BOTH = f"SELECT series, value FROM ({SERIES_SQL}) UNION ALL SELECT 'all', value FROM events WHERE event_type <> 'click'"


@query(
    "agg_summary",
    f"SELECT *, 'sample' AS variant FROM ({_summary_sql(_BOTH, 'series', 'stddev_samp', *INDEX_Q)}) UNION ALL SELECT *, 'population' FROM ({_summary_sql(_BOTH, 'series', 'stddev_pop', *AVG4_Q)})",
)
def agg_summary(spark, d):
    s = series(spark, d).select("series", "value")
    both = s.unionByName(s.filter("series <> 'click'").withColumn("series", F.lit("all")))
    return ag.summary(both, ["series"], "value").withColumn("variant", F.lit("sample")).unionByName(
        ag.summary(both, ["series"], "value", "population", "avg4").withColumn("variant", F.lit("population"))
    )


LOG_SQL = """SELECT o_orderkey AS query_id, o_orderdate AS start_time, CAST(floor(o_totalprice / 200) AS BIGINT) AS duration_ms, o_orderpriority AS query_type,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'Failed' WHEN o_orderkey % 37 = 0 THEN 'Timeout' ELSE 'Completed' END AS status,
    o_orderkey % 1000 AS rows_processed, o_orderkey % 100 AS rows_returned FROM orders"""


def query_log(spark, d):
    """orders as a query execution log."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS query_id",
        "o_orderdate AS start_time",
        "CAST(floor(o_totalprice / 200) AS BIGINT) AS duration_ms",
        "o_orderpriority AS query_type",
        "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'Failed' WHEN o_orderkey % 37 = 0 THEN 'Timeout' ELSE 'Completed' END AS status",
        "o_orderkey % 1000 AS rows_processed",
        "o_orderkey % 100 AS rows_returned",
    )


@query(
    "agg_querylog",
    f"""WITH l AS ({LOG_SQL}), p AS ({_ranked('l', 'query_type', 'duration_ms', {k: v for k, v in _ROUND.items() if k != 'p90'})})
    SELECT l.query_type, count(*) AS total_queries, count(CASE WHEN status = 'Completed' THEN 1 END) AS successful_queries, count(CASE WHEN status = 'Failed' THEN 1 END) AS failed_queries,
      round(avg(duration_ms), 6) AS avg_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms, CAST(sum(rows_processed) AS BIGINT) AS rows_processed, CAST(sum(rows_returned) AS BIGINT) AS rows_returned,
      round(count(CASE WHEN status = 'Failed' THEN 1 END) / count(*), 6) AS error_rate, round(count(*) / 3600, 6) AS throughput_qps, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99
    FROM l JOIN p ON l.query_type = p.query_type GROUP BY l.query_type""",
)
def agg_querylog(spark, d):
    return ag.query_log_stats(query_log(spark, d), ["query_type"])
