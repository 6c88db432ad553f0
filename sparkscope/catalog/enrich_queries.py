"""Enrichment and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkscope.catalog import query
from sparkscope.model import FLAT_SQL, flat, newest, records, table
from sparkscope.operators import enrich as en
from sparkscope.operators import transforms as tr
from sparkscope.operators.enrich import EnrichRule

REC = f"WITH rec AS ({FLAT_SQL}) "

def attr(key):
    return F.col("attributes")[key]


@query(
    "enrich_time",
    """SELECT event_id AS id, CAST(epoch_us(m) - epoch_us(ts) AS BIGINT) // 1000000 AS age_seconds, CAST(hour(ts) AS INTEGER) AS hour_of_day,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, isodow(ts) >= 6 AS is_weekend FROM events, (SELECT max(ts) AS m FROM events)""",
)
def enrich_time(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    return en.time_parts(rows, newest(rows)).drop("timestamp")


@query(
    "enrich_time_struct",
    """SELECT event_id AS id, epoch_us(ts) // 1000 AS ms, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
    CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second, 'UTC' AS zone FROM events""",
)
def enrich_time_struct(spark, d):
    t = en.time_struct(F.col("ts"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), t.alias("t")).select(
        "id",
        F.col("t.timestamp").alias("ms"),
        *[f"t.{p}" for p in ("year", "month", "day", "hour", "minute", "second")],
        F.col("t.timezone").alias("zone"),
    )


@query(
    "enrich_service",
    REC
    + """SELECT id, coalesce('Nation ' || n.n_nationkey, found, 'unknown') AS service FROM (
       SELECT id, coalesce(a_service, t_service, CASE WHEN k % 6 = 2 THEN concat('own-', t_region) END) AS found FROM rec) f
    LEFT JOIN nation n ON f.found = concat('svc-', CAST(n.n_nationkey AS VARCHAR))""",
)
def enrich_service(spark, d):
    mapping = table(spark, d, "nation").select(
        F.concat(F.lit("svc-"), F.col("n_nationkey").cast("string")).alias("from"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("to"),
    )
    return en.service(records(spark, d), mapping, "unknown").select("id", attr("service.name").alias("service"))


@query(
    "enrich_environment",
    REC
    + """SELECT id, CASE coalesce(a_env, CASE WHEN k % 5 = 2 THEN 'dev' END) WHEN 'prod' THEN 'production' WHEN 'staging' THEN 'staging' WHEN 'dev' THEN 'dev' ELSE 'none' END AS environment FROM rec""",
)
def enrich_environment(spark, d):
    mapping = table(spark, d, "region").filter("r_regionkey = 0").select(
        F.lit("prod").alias("from"), F.lit("production").alias("to")
    )
    return en.environment(records(spark, d), mapping, "none").select("id", attr("environment").alias("environment"))


@query(
    "enrich_rules",
    REC
    + """SELECT id, coalesce(a_env, 'n/a') AS env_copy, regexp_extract(a_url, '/p/([0-9]+)', 1) AS page, 'fixed' AS fixed,
       upper(t_region) AS area, regexp_extract(a_url, '^https?://([^/]*)', 1) AS host,
       concat(record_type, '-', id) AS joined, CASE WHEN a_service IS NOT NULL THEN concat(left(a_service, 3), '...') END AS short FROM rec""",
)
def enrich_rules(spark, d):
    rules = [
        EnrichRule("env_copy", "copy", "env", default="n/a"),
        EnrichRule("page", "regex", "url", "/p/([0-9]+)"),
        EnrichRule("fixed", "static", "fixed"),
        EnrichRule("area", "transform", "tags.region", F.upper),
        EnrichRule("host", "transform", "url", tr.url_domain),
        EnrichRule("joined", "expression", "concat(record_type, '-', id)"),
        EnrichRule("short", "transform", "attributes.service.name", lambda c: tr.truncate(c, 3)),
        EnrichRule("off", "static", "never", enabled=False),
    ]
    names = ("env_copy", "page", "fixed", "area", "host", "joined", "short")
    return en.by_rules(records(spark, d), rules).select("id", *[attr(n).alias(n) for n in names])


@query(
    "enrich_lookup",
    """SELECT e.event_id AS id, e.event_type, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""",
)
def enrich_lookup(spark, d):
    out = en.lookup(table(spark, d, "events"), "user_id", table(spark, d, "customer"), "c_custkey", "c_mktsegment", "segment")
    return out.select(F.col("event_id").alias("id"), "event_type", "segment")


@query(
    "enrich_computed",
    """SELECT event_id AS id, event_type = 'error' AS is_error, CASE WHEN event_type = 'signup' THEN 'unknown' WHEN value * 4 < 100 THEN 'fast' WHEN value * 4 < 500 THEN 'medium' ELSE 'slow' END AS response_time_category FROM events""",
)
def enrich_computed(spark, d):
    took = F.when(F.col("event_type") != "signup", F.col("value") * 4)
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        en.is_error(F.col("event_type")).alias("is_error"),
        en.response_class(took).alias("response_time_category"),
    )


@query(
    "enrich_correlation",
    REC + "SELECT id, CASE WHEN k % 4 = 0 THEN a_user ELSE sha256(id) END AS correlation_id FROM rec",
)
def enrich_correlation(spark, d):
    known = F.when(attr("k").cast("int") % 4 == 0, attr("user"))
    out = en.correlation(tr.set_field(records(spark, d), "correlation_id", known))
    return out.select("id", attr("correlation_id").alias("correlation_id"))


DRAW = "(CAST('0x' || left(md5(id), 8) AS BIGINT) % 10000) / 10000.0"


@query("sample_rate", REC + f"SELECT id, record_type, value FROM rec WHERE {DRAW} < 0.25")
def sample_rate(spark, d):
    return en.sample(flat(spark, d).select("id", "record_type", "value"), 0.25)


@query(
    "sample_by_severity",
    REC
    + f"""SELECT id, record_type, log_level AS level, span_status AS status FROM rec WHERE {DRAW} <
    CASE record_type WHEN 'Trace' THEN CASE WHEN span_status = 'Error' THEN 1.0 ELSE 0.1 END
    WHEN 'Log' THEN CASE WHEN log_level IN ('Error', 'Fatal') THEN 1.0 WHEN log_level = 'Warn' THEN 0.5 ELSE 0.1 END ELSE 1.0 END""",
)
def sample_by_severity(spark, d):
    return en.sample(records(spark, d), en.severity_rate()).select(
        "id", "record_type", F.col("log.level").alias("level"), F.col("trace.status_code").alias("status")
    )
