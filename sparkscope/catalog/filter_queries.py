"""Filters, predicates and structured telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, SPANS_SQL, flat, newest, records, spans, table
from sparkscope.operators import filters as fl
from sparkscope.operators.filters import Rule
from sparkscope.plans.tquery import Aggregation, TelemetryQuery, TimeRange, run

REC = f"WITH rec AS ({FLAT_SQL}) "
SVC = f"WITH svc AS ({SPANS_SQL}), clock AS (SELECT max(timestamp) AS as_of FROM svc) "


@query(
    "field_resolve",
    REC
    + """SELECT id, record_type AS f_type, a_k AS f_k, t_region AS f_region, metric_name AS f_metric,
       metric_unit AS f_unit, CASE WHEN metric_name IS NOT NULL THEN event_type END AS f_label,
       a_env AS f_env, log_message AS f_message,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0
         THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END || '+00:00' AS f_ts FROM rec""",
)
def field_resolve(spark, d):
    return records(spark, d).select(
        "id",
        fl.resolve("record_type").alias("f_type"),
        fl.resolve("k").alias("f_k"),
        fl.resolve("region").alias("f_region"),
        fl.resolve("metric.name").alias("f_metric"),
        fl.resolve("metric.unit").alias("f_unit"),
        fl.resolve("kind").alias("f_label"),
        fl.resolve("attributes.env").alias("f_env"),
        fl.resolve("data.log.message").alias("f_message"),
        fl.resolve("timestamp").alias("f_ts"),
    )


OP_RULES = {
    "eq": Rule("env", "eq", "prod"),
    "ne": Rule("env", "ne", "prod"),
    "contains": Rule("url", "contains", "host1"),
    "not_contains": Rule("data.log.message", "not_contains", "timeout"),
    "gt": Rule("status_code", "gt", "300"),
    "ge": Rule("k", "ge", "50"),
    "lt": Rule("k", "lt", "10"),
    "le": Rule("metric.value", "le", "25.5"),
    "in": Rule("region", "in", "r1, r3"),
    "not_in": Rule("env", "not_in", "prod,dev"),
    "exists": Rule("env", "exists"),
    "not_exists": Rule("service.name", "not_exists"),
    "starts_with": Rule("data.metric.name", "starts_with", "http"),
    "ends_with": Rule("url", "ends_with", "7"),
    "regex": Rule("data.log.message", "regex", "u[0-9]+$|full"),
}
_OP_SQL = {
    "eq": "a_env = 'prod'",
    "ne": "a_env <> 'prod'",
    "contains": "contains(a_url, 'host1')",
    "not_contains": "NOT contains(log_message, 'timeout')",
    "gt": "TRY_CAST(a_status AS DOUBLE) > 300",
    "ge": "TRY_CAST(a_k AS DOUBLE) >= 50",
    "lt": "TRY_CAST(a_k AS DOUBLE) < 10",
    "le": "metric_value <= 25.5",
    "in": "t_region IN ('r1', 'r3')",
    "not_in": "a_env NOT IN ('prod', 'dev')",
    "exists": "a_env IS NOT NULL",
    "not_exists": "a_service IS NULL",
    "starts_with": "starts_with(metric_name, 'http')",
    "ends_with": "suffix(a_url, '7')",
    "regex": "regexp_matches(log_message, 'u[0-9]+$|full')",
}


@query(
    "filter_ops",
    REC + "SELECT id, " + ", ".join(f"coalesce({t}, false) AS m_{n}" for n, t in _OP_SQL.items()) + " FROM rec",
)
def filter_ops(spark, d):
    return records(spark, d).select("id", *[fl.predicate(r).alias(f"m_{n}") for n, r in OP_RULES.items()])


_TWO = [Rule("env", "eq", "prod"), Rule("k", "gt", "40")]
_A, _B = "coalesce(a_env = 'prod', false)", "coalesce(TRY_CAST(a_k AS DOUBLE) > 40, false)"


@query(
    "filter_any_all",
    REC
    + f"""SELECT 'any' AS form, id FROM rec WHERE {_A} OR {_B}
    UNION ALL SELECT 'all', id FROM rec WHERE {_A} AND {_B}
    UNION ALL SELECT 'inverted', id FROM rec WHERE NOT ({_A} AND {_B})""",
)
def filter_any_all(spark, d):
    rec = records(spark, d)
    forms = {
        "any": fl.match(rec, _TWO, any_of=True),
        "all": fl.match(rec, _TWO),
        "inverted": fl.match(rec, _TWO, invert=True),
    }
    out = None
    for form, df in forms.items():
        one = df.select(F.lit(form).alias("form"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("filter_first_match", REC + f"SELECT id, record_type FROM rec WHERE NOT ({_A} OR {_B})")
def filter_first_match(spark, d):
    off = Rule("record_type", "eq", "Log", enabled=False)
    return fl.by_first_match(records(spark, d), [*_TWO, off], "exclude").select("id", "record_type")


@query("filter_all_rules", REC + f"SELECT id, record_type FROM rec WHERE {_A} AND {_B}")
def filter_all_rules(spark, d):
    return fl.by_all_rules(records(spark, d), _TWO).select("id", "record_type")


@query(
    "filter_rule_sequence",
    REC
    + """SELECT id, k, event_type, a_env FROM rec
    WHERE k BETWEEN 10 AND 80 AND event_type IN ('click', 'error', 'view')
      AND NOT (a_env IS NULL) AND NOT (a_url LIKE '%host2%') AND coalesce(record_type NOT IN ('Event'), false)""",
)
def filter_rule_sequence(spark, d):
    rules = [
        Rule("k", "between", [10, 80]),
        Rule("event_type", "in", ["click", "error", "view"]),
        Rule("a_env", "is_null", action="exclude"),
        Rule("a_env", "is_not_null"),
        Rule("a_url", "contains", "host2", action="exclude"),
        Rule("record_type", "not_in", ["Event"]),
    ]
    return fl.in_sequence(flat(spark, d), rules).select("id", "k", "event_type", "a_env")


@query(
    "filter_null_rows",
    REC + "SELECT id, metric_value, a_env, a_service FROM rec WHERE metric_value IS NOT NULL AND a_env IS NOT NULL AND a_service IS NOT NULL",
)
def filter_null_rows(spark, d):
    return fl.without_nulls(flat(spark, d).select("id", "metric_value", "a_env", "a_service"))


@query(
    "filter_condition_expr",
    REC
    + """SELECT id, coalesce(a_env = 'prod', false) AS c_eq, coalesce(a_env <> 'prod', false) AS c_ne,
       coalesce(TRY_CAST(a_status AS DOUBLE) > 300, false) AS c_gt,
       coalesce(TRY_CAST(a_k AS DOUBLE) < 7, false) AS c_lt, coalesce(a_k = '1', false) AS c_flag FROM rec""",
)
def filter_condition_expr(spark, d):
    at = fl.resolve
    return records(spark, d).select(
        "id",
        fl.when_true(at("attributes.env"), "==", "prod").alias("c_eq"),
        fl.when_true(at("attributes.env"), "!=", "prod").alias("c_ne"),
        fl.when_true(at("attributes.status_code"), ">", 300).alias("c_gt"),
        fl.when_true(at("attributes.k"), "<", 7).alias("c_lt"),
        fl.when_true(at("attributes.k")).alias("c_flag"),
    )


@query(
    "time_range_last",
    SVC
    + """SELECT id, timestamp, 'hours' AS span FROM svc, clock WHERE timestamp >= as_of - INTERVAL 6 HOUR AND timestamp <= as_of
    UNION ALL SELECT id, timestamp, 'days' FROM svc, clock WHERE timestamp >= as_of - INTERVAL 2 DAY AND timestamp <= as_of""",
)
def time_range_last(spark, d):
    rows = spans(spark, d).select("id", "timestamp")
    clock = newest(rows)
    return fl.since(rows, clock, hours=6).withColumn("span", F.lit("hours")).unionByName(
        fl.since(rows, clock, days=2).withColumn("span", F.lit("days"))
    )


@query(
    "batch_cap",
    REC
    + """SELECT batch_id, id, metric_name FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY event_id) AS rn FROM rec)
    WHERE rn <= 25""",
)
def batch_cap(spark, d):
    return fl.first_per_batch(flat(spark, d), 25, order="event_id").select("batch_id", "id", "metric_name")


@query(
    "select_project",
    """SELECT l_orderkey AS order_id, l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 6) AS net,
       upper(l_returnflag) AS flag, l_quantity + 1 AS qty1 FROM lineitem""",
)
def select_project(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS line",
        "round(l_extendedprice * (1 - l_discount), 6) AS net",
        "upper(l_returnflag) AS flag",
        "l_quantity + 1 AS qty1",
    )


@query(
    "select_where",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
      AND (l_quantity BETWEEN 5 AND 20 OR l_returnflag IN ('R')) AND l_linestatus LIKE 'O%' AND NOT l_discount > 0.05""",
)
def select_where(spark, d):
    return table(spark, d, "lineitem").where(
        """l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
      AND (l_quantity BETWEEN 5 AND 20 OR l_returnflag IN ('R')) AND l_linestatus LIKE 'O%' AND NOT l_discount > 0.05"""
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query(
    "tq_metrics",
    REC
    + """SELECT metric_name, count(*) AS n, round(avg(metric_value), 6) AS avg_value, round(sum(metric_value), 6) AS sum_value,
       min(metric_value) AS lo, max(metric_value) AS hi, count(DISTINCT metric_value) AS card, median(metric_value) AS mid,
       list_sort(list(metric_value))[least(floor(0.9 * count(metric_value))::BIGINT, count(metric_value) - 1) + 1] AS p90
    FROM rec WHERE record_type = 'Metric' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'
      AND t_region IN ('r1', 'r2', 'r3') AND TRY_CAST(a_k AS DOUBLE) >= 20 GROUP BY metric_name""",
)
def tq_metrics(spark, d):
    ask = TelemetryQuery(
        "Metrics",
        time_range=TimeRange("2024-01-03", "2024-01-20"),
        filters=[Rule("region", "in", "r1,r2,r3"), Rule("k", "ge", 20)],
        group_by={"metric_name": "metric.name"},
        aggregations=[
            Aggregation("count", None, "n"),
            Aggregation("avg", "metric.value", "avg_value"),
            Aggregation("sum", "metric.value", "sum_value"),
            Aggregation("min", "metric.value", "lo"),
            Aggregation("max", "metric.value", "hi"),
            Aggregation("cardinality", "metric.value", "card"),
            Aggregation("median", "metric.value", "mid"),
            Aggregation("percentile", "metric.value", "p90", 90),
        ],
    )
    return run(ask, records(spark, d))


@query(
    "tq_histogram",
    REC
    + """SELECT metric_name, string_agg(b0::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY b0) AS spread FROM (SELECT metric_name, floor(metric_value / 25) * 25 AS b0, count(*) AS n
    FROM rec WHERE record_type = 'Metric' AND metric_value IS NOT NULL GROUP BY ALL) GROUP BY metric_name""",
)
def tq_histogram(spark, d):
    ask = TelemetryQuery("Metrics", group_by={"metric_name": "metric.name"}, aggregations=[Aggregation("histogram", "metric.value", "spread", 25)])
    return run(ask, records(spark, d))


@query("tq_paged", REC + "SELECT id, ts AS timestamp, log_level AS level FROM rec WHERE record_type = 'Log' ORDER BY ts, id OFFSET 20")
def tq_paged(spark, d):
    """All logs after the first twenty, placed by position."""
    return run(TelemetryQuery("Logs", select={"level": "log.level"}, offset=20), records(spark, d))


@query(
    "tq_traces",
    REC
    + """SELECT id, ts AS timestamp, trace_id, span_id, span_name, duration_ns FROM rec
    WHERE record_type = 'Trace' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28'
      AND span_name = '  page::View2()  ' AND span_status = 'Ok'
    ORDER BY ts, id LIMIT 20 OFFSET 10""",
)
def tq_traces(spark, d):
    ask = TelemetryQuery(
        "Traces",
        time_range=TimeRange("2024-01-02", "2024-01-28"),
        where={"operation": "  page::View2()  ", "status": "Ok"},
        select={
            "trace_id": "trace.trace_id",
            "span_id": "trace.span_id",
            "span_name": "trace.name",
            "duration_ns": "trace.duration_ns",
        },
        limit=20,
        offset=10,
    )
    return run(ask, records(spark, d))


@query(
    "tq_logs",
    REC
    + """SELECT id, ts AS timestamp, log_level AS level, log_message AS message FROM rec
    WHERE record_type = 'Log' AND log_level IN ('Error', 'Fatal') AND contains(log_message, 'timeout')
      AND ts >= (SELECT max(ts) FROM rec) - INTERVAL 240 HOUR""",
)
def tq_logs(spark, d):
    rec = records(spark, d)
    ask = TelemetryQuery(
        "Logs",
        time_range=TimeRange(last_hours=240, as_of=newest(rec)),
        filters=[Rule("data.log.message", "contains", "timeout")],
        where={"level": ["Error", "Fatal"]},
        select={"level": "log.level", "message": "log.message"},
    )
    return run(ask, rec)


@query(
    "tq_all",
    REC
    + """SELECT record_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM rec
    WHERE coalesce(a_env <> 'prod', false) GROUP BY record_type""",
)
def tq_all(spark, d):
    ask = TelemetryQuery(
        "All",
        filters=[Rule("env", "ne", "prod")],
        group_by={"record_type": "record_type"},
        aggregations=[
            Aggregation("count", None, "n"),
            Aggregation("min", "timestamp", "first_ts"),
            Aggregation("max", "timestamp", "last_ts"),
        ],
    )
    return run(ask, records(spark, d))
